"""Periodic domains by full tiling, and the transaction of a persistent periodic mesh.

Visible nodes are joined with all shifts in {-1, 0, 1} of the periodic axes; cells are
built for visible nodes only, among all images. A result is certain if the ball of
each visible vertex lies within the tiled box; else the tiling is widened.

A transaction removes and appends visible nodes. Only cells that lose a vertex to a
new image, or touch an image that goes, are built again, beside the new ones and
the unbounded ones. Cells are integrated among the images; integrands are evaluated at
points moved back into the domain, and each interface comes with its other side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..plans.boundary import PERIODIC, Boundary
from .construct import cell_rows
from .incremental import reached
from .state import released, settled


def shifts(boundary: Boundary, reach: int = 1) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """(steps per periodic pair, vector) of all images, the one that isn't shifted first."""
    pairs = boundary.periodic_pairs()
    steps = sorted(product(range(-reach, reach + 1), repeat=len(pairs)), key=lambda s: (sum(map(abs, s)), s))
    # Moving over a plane's partner is a step against the plane's own shift.
    return [(s, sum((-k * v for k, (_, _, v) in zip(s, pairs, strict=True)), np.zeros(boundary.dim))) for s in steps]


def images(nodes: DataFrame, boundary: Boundary, reach: int = 1) -> DataFrame:
    """Visible nodes and their shifted references; ids: id * number of shifts + place of the shift."""
    all_ = shifts(boundary, reach)
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, s)).cast("array<int>").alias("shift"), vec.literal(v).alias("v")) for k, (s, v) in enumerate(all_)])
    rows = nodes.select("id", "coords", F.explode(table).alias("s"))
    return rows.select(
        (F.col("id") * len(all_) + F.col("s.k")).alias("id"),
        vec.add("coords", "s.v").alias("coords"),
        F.lit(True).alias("active"),
        F.when(F.col("s.k") == 0, "visible").otherwise("reference").alias("kind"),
        F.when(F.col("s.k") > 0, F.col("id")).alias("ref_id"),
        F.when(F.col("s.k") > 0, F.col("s.shift")).alias("shift"),
    )


def find_reference(images_: DataFrame, wanted: DataFrame) -> DataFrame:
    """Existing references (ref_id, shift)."""
    return images_.join(wanted.select("ref_id", "shift"), ["ref_id", "shift"], "left_semi")


def missing_references(planned: DataFrame, existing: DataFrame) -> DataFrame:
    return planned.join(existing.select("ref_id", "shift"), ["ref_id", "shift"], "left_anti")


def requests(vertices: DataFrame, images_: DataFrame, boundary: Boundary) -> DataFrame:
    """(node, plane): visible nodes whose vertices touch a periodic plane or a reference across it."""
    planes = [i for i, p in enumerate(boundary.planes) if p.cond == PERIODIC]
    touched = vertices.select(F.explode(F.filter("sigma", lambda s: s >= 0)).alias("node"), F.explode(F.filter("sigma", lambda s: s < 0)).alias("p")).select("node", (-1 - F.col("p")).cast("int").alias("plane")).filter(F.col("plane").isin(planes)) if planes else None
    refs = images_.filter("kind = 'reference'").select(F.col("id").alias("ref"), "shift")
    pairs = boundary.periodic_pairs()
    plane_of = F.flatten(F.array(*[F.when(F.col("shift")[k] > 0, F.array(F.lit(a))).when(F.col("shift")[k] < 0, F.array(F.lit(b))).otherwise(F.array().cast("array<int>")) for k, (a, b, _) in enumerate(pairs)])) if pairs else F.array().cast("array<int>")
    rows = vertices.select("sigma", F.explode("sigma").alias("ref")).join(refs, "ref").select(F.explode("sigma").alias("node"), plane_of.alias("planes"), "ref").filter("node <> ref").select("node", F.explode("planes").alias("plane"))
    out = rows if touched is None else rows.union(touched)
    return out.join(images_.filter("kind = 'visible'").select(F.col("id").alias("node")), "node", "left_semi").distinct()


@dataclass
class Transaction:
    """What a transaction did: ids of visible nodes, and vertices (cell, sigma, position) among the images."""

    appended: DataFrame
    removed: DataFrame
    affected: DataFrame
    invalidated: DataFrame
    new_vertices: DataFrame


@dataclass
class PeriodicMesh:
    """Visible nodes, and the vertices of each visible cell among all images."""

    nodes: DataFrame
    boundary: Boundary
    images: DataFrame = None
    rows: DataFrame = None
    count: int = 1
    reach: int = 1
    staged: list[DataFrame] = field(default_factory=list)
    added: list[DataFrame] = field(default_factory=list)
    report: Transaction | None = None

    def compute(self, reach: int = 1, strategy: str = "auto") -> PeriodicMesh:
        """Builds visible cells: all of them at first, later those that staged removals and insertions change, with a report."""
        if self.rows is not None and self.reach >= reach and (self.staged or self.added):
            self._transaction(strategy)
        else:
            self._settle()
            self._build(max(reach, self.reach), strategy)
        return self

    def _settle(self) -> tuple[DataFrame, DataFrame]:
        """Takes staged changes into the nodes; (ids removed, nodes added)."""
        empty = self.nodes.limit(0)
        gone, new = empty.select("id"), empty
        for ids in self.staged:
            gone = gone.union(ids)
        for rows in self.added:
            new = new.unionByName(rows)
        if self.staged or self.added:
            gone, new = settled(gone.join(self.nodes.select("id"), "id", "left_semi").distinct()), settled(new)
            self.nodes = settled(self.nodes.join(gone, "id", "left_anti").unionByName(new))
        self.staged, self.added = [], []
        return gone, new

    def _cells(self, wanted: DataFrame, strategy: str) -> DataFrame:
        """Rows of visible cells among all images; walls have the names that they have in the boundary."""
        walls = Boundary(self.boundary.dim, [p for p in self.boundary.planes if p.cond != PERIODIC])
        names = [i for i, p in enumerate(self.boundary.planes) if p.cond != PERIODIC]
        rows = cell_rows(self.images, walls, wanted, strategy=strategy, all_of=True)
        back = F.transform("sigma", lambda s: F.when(s >= 0, s).otherwise(F.element_at(F.array(*[F.lit(-1 - n).cast("long") for n in names]) if names else F.array(F.lit(0).cast("long")), F.greatest(-s, F.lit(1)).cast("int"))))
        return rows.withColumn("sigma", F.array_sort(back))

    def _build(self, reach: int, strategy: str) -> None:
        while True:
            self.reach, self.count = reach, len(shifts(self.boundary, reach))
            self.images = images(self.nodes, self.boundary, reach).persist()
            self.rows = self._cells(self.images.filter("kind = 'visible'"), strategy).persist()
            if self.uncertain(reach).isEmpty():
                return
            released(self.images, self.rows)
            reach += 1

    def _transaction(self, strategy: str) -> None:
        old, before = self.rows, self.images
        gone, new = self._settle()
        self.images = settled(images(self.nodes, self.boundary, self.reach))
        lost = before.join(self.images.select("id"), "id", "left_anti").select("id")
        made = self.images.join(before.select("id"), "id", "left_anti")
        hit = old.select("cell", F.explode("sigma").alias("id")).join(lost, "id", "left_semi").select("cell")
        own = before.select(F.col("id").alias("cell"), F.col("coords").alias("x"))
        v = old.filter("kind = 'vertex'").join(own, "cell").select("cell", "sigma", "position", vec.distance("position", "x").alias("r"))
        cut = settled(reached(v, made).select("cell", "sigma", "position"))
        open_ = old.filter("kind = 'edge'").select("cell")
        redo = hit.union(cut.select("cell")).union(open_).select(F.col("cell").alias("id"))
        redo = settled(redo.union(made.filter("kind = 'visible'").select("id")).distinct().join(self.images.select("id"), "id", "left_semi"))
        fresh = settled(self._cells(redo, strategy)) if not redo.isEmpty() else old.limit(0)
        kept = old.join(redo.select(F.col("id").alias("cell")), "cell", "left_anti").join(self.images.select(F.col("id").alias("cell")), "cell", "left_semi")
        self.rows = settled(kept.select(*old.columns).unionByName(fresh.select(*old.columns)))
        visible = lambda rows: rows.select(F.floor(F.col("id") / self.count).cast("long").alias("id"))
        self.report = Transaction(new.select("id"), gone, visible(redo).join(new.select("id"), "id", "left_anti"), cut, fresh.filter("kind = 'vertex'").select("cell", "sigma", "position"))
        if not self.uncertain(self.reach).isEmpty():
            self._build(self.reach + 1, strategy)

    def uncertain(self, reach: int) -> DataFrame:
        """Visible vertices whose ball leaves the tiled box, or unbounded edges along a periodic axis."""
        own = self.images.select(F.col("id").alias("cell"), "coords")
        v = self.rows.filter("kind = 'vertex'").join(own, "cell").withColumn("r", vec.distance("position", "coords"))
        out = F.lit(False)
        for a, b, shift in self.boundary.periodic_pairs():
            p, q = self.boundary.planes[a], self.boundary.planes[b]
            width = float(np.linalg.norm(shift))
            for plane in (p, q):
                out = out | (vec.dot(vec.sub("position", vec.literal(plane.base)), vec.literal(plane.normal)) + F.col("r") > reach * width + 1e-9)
        bad = v.filter(out).select("cell")
        edges = F.lit(False)
        for a, _, _ in self.boundary.periodic_pairs():
            edges = edges | (F.abs(vec.dot("direction", vec.literal(self.boundary.planes[a].normal))) > 1e-9)
        return bad.union(self.rows.filter("kind = 'edge'").filter(edges).select("cell"))

    def owner(self):
        return lambda s: F.when(s >= 0, F.floor(s / self.count)).otherwise(s)

    def public_vertices(self) -> DataFrame:
        """(cell, sigma, position) of visible cells: generators by owner, positions moved into the domain."""
        low, length = self._axes()
        sigma = F.array_sort(F.transform("sigma", self.owner()))
        position = vec.wrapped("position", low, length)
        return self.rows.filter("kind = 'vertex'").select(F.floor(F.col("cell") / self.count).cast("long").alias("cell"), sigma.alias("sigma"), position.alias("position"))

    def _axes(self):
        """Corner and periodic lengths of a box, null along other axes."""
        low, length = self._box()
        return vec.literal(low), F.array(*[F.lit(float(x) if np.isfinite(x) else None) for x in length]).cast("array<double>")

    def vertices(self) -> DataFrame:
        """(sigma, position) among the images, each once."""
        return self.rows.filter("kind = 'vertex'").select("sigma", "position").dropDuplicates(["sigma"])

    def integrate(self, f: Callable | None = None, method: str = "fast_polygon") -> tuple[DataFrame, DataFrame]:
        """(cells, interfaces) of visible cells: cells(cell, volume, bulk), interfaces(cell, neighbour, shift, area, integral, other_area).

        shift tells over which periodic pairs the neighbour's image lies, null for
        walls. Integrands see points moved back into the domain. other_area is the
        same interface as the neighbour's cell has it.
        """
        from . import integrate as own
        from .mesh import reciprocal

        if f is not None:
            inner, lo, length = f, *self._box()
            wide = np.isfinite(length)
            tol = 64 * np.finfo(float).eps * np.where(wide, length, 1.0)

            def f(x: np.ndarray) -> np.ndarray:
                over = wide & ((x < lo - tol) | (x > lo + length + tol))
                return inner(np.where(over, lo + np.mod(x - lo, np.where(wide, length, 1.0)), x))

        visible = self.images.filter("kind = 'visible'").select("id", "coords")
        rows = settled(own.exact(self.images.select("id", "coords"), self.vertices(), f, method, visible))
        public = F.floor(F.col("cell") / self.count).cast("long")
        cells = rows.filter("neighbour is null").select(public.alias("cell"), F.col("measure").alias("volume"), F.col("integral").alias("bulk"))
        steps = F.array(*[F.array(*map(F.lit, s)).cast("array<int>") for s, _ in shifts(self.boundary, self.reach)])
        inside = F.col("neighbour") >= 0
        interfaces = rows.filter("neighbour is not null").select(
            public.alias("cell"),
            F.when(inside, F.floor(F.col("neighbour") / self.count)).otherwise(F.col("neighbour")).cast("long").alias("neighbour"),
            F.when(inside, F.element_at(steps, (F.pmod(F.greatest("neighbour", F.lit(0)), F.lit(self.count)) + 1).cast("int"))).alias("shift"),
            F.col("measure").alias("area"),
            "integral",
        )
        return cells, reciprocal(interfaces)

    def _box(self) -> tuple[np.ndarray, np.ndarray]:
        """Corner and periodic lengths, infinite along other axes."""
        low, length = np.zeros(self.boundary.dim), np.full(self.boundary.dim, np.inf)
        for a, b, _ in self.boundary.periodic_pairs():
            p, q = self.boundary.planes[a], self.boundary.planes[b]
            k = int(np.abs(p.normal).argmax())
            low[k], length[k] = min(p.base[k], q.base[k]), abs(p.base[k] - q.base[k])
        return low, length

    def append(self, new: DataFrame) -> PeriodicMesh:
        """Stages visible nodes, which must lie in the domain; the next compute() takes them in."""
        from ..plans.boundary import check_nodes

        self.added.append(check_nodes(new.select(*self.nodes.columns), self.boundary))
        return self

    def stage_removal(self, ids: DataFrame) -> PeriodicMesh:
        self.staged.append(ids.select("id"))
        return self
