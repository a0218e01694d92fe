"""Facade: meshes and integrals as handles over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import construct, incremental, integrate, mesh, search, validate
from .operators.periodic import PeriodicMesh
from .operators.spherical import SphericalMesh
from .operators.state import released, settled
from .plans.boundary import Boundary, check_nodes

__all__ = ["Integral", "PeriodicMesh", "SphericalMesh", "VoronoiMesh"]


class VoronoiMesh:
    """An ordinary mesh: ``VoronoiMesh.from_df(nodes, boundary).compute()``."""

    def __init__(self, nodes: DataFrame, boundary: Boundary | None = None, strategy: str = "auto"):
        self.nodes = nodes if boundary is None else check_nodes(nodes, boundary)
        self.boundary, self.strategy = boundary, strategy
        self.state: incremental.Mesh | None = None
        self.version, self.changed = 0, None
        self._near, self._stale, self._dim = None, None, None

    @classmethod
    def from_df(cls, nodes: DataFrame, boundary: Boundary | None = None, strategy: str = "auto") -> VoronoiMesh:
        return cls(nodes, boundary, strategy)

    @property
    def dim(self) -> int:
        if self._dim is None:
            self._dim = construct.dimension(self.nodes)
        return self._dim

    def compute(self) -> VoronoiMesh:
        if self.state is not None:
            released(self.state.held, self._near)
        self.state = incremental.build(self.nodes, self.boundary, self.strategy)
        self.version, self.changed = self.version + 1, None
        self._near, self._stale = None, None
        return self

    def _built(self) -> incremental.Mesh:
        if self.state is None:
            self.compute()
        return self.state

    @property
    def vertices(self) -> DataFrame:
        return self._built().vertices

    @property
    def infinite_edges(self) -> DataFrame:
        return self._built().infinite_edges

    def neighbours(self) -> DataFrame:
        """(cell, neighbour), kept from one call to the next; after a change only the cells that it touched are looked at again."""
        self._built()
        if self._near is None:
            self._near = mesh.neighbours(self.vertices, self.dim, self.infinite_edges).persist()
        elif self._stale is not None:
            dirty = self._stale.select(F.col("id").alias("cell"))
            touch = lambda rows: rows.join(rows.select("sigma", F.explode("sigma").alias("cell")).join(dirty, "cell", "left_semi").select("sigma").distinct(), "sigma", "left_semi")
            fresh = mesh.neighbours(touch(self.vertices), self.dim, touch(self.infinite_edges)).join(dirty, "cell", "left_semi")
            alive = self.nodes.select(F.col("id").alias("cell"))
            kept = self._near.join(dirty, "cell", "left_anti").join(alive, "cell", "left_semi")
            before, self._near = self._near, settled(kept.unionByName(fresh))
            released(before)
        self._stale = None
        return self._near

    def adjacency(self) -> DataFrame:
        return mesh.adjacency(self.vertices)

    def set_boundary(self, boundary: Boundary | None) -> VoronoiMesh:
        return VoronoiMesh(self.nodes, boundary, self.strategy)

    def _moved(self, state: incremental.Mesh, report: incremental.Report) -> incremental.Report:
        # The new state is settled; the tables of the old one are read no more.
        released(self.state.held)
        self.state, self.nodes = state, state.nodes
        self.version += 1
        now = settled(incremental.dirty(report.appended, report.affected))
        self.changed = now if self.changed is None else settled(incremental.dirty(self.changed, now))
        self._stale = now if self._stale is None else settled(incremental.dirty(self._stale, now))
        return report

    def refine(self, new: DataFrame) -> incremental.Report:
        return self._moved(*incremental.refine(self._built(), new if self.boundary is None else check_nodes(new, self.boundary)))

    def remove(self, ids: DataFrame) -> incremental.Report:
        return self._moved(*incremental.remove(self._built(), ids))

    def nearest(self, queries: DataFrame, k: int = 1) -> DataFrame:
        return search.knn(queries, self.nodes, k)

    def wrong_vertices(self, **kind) -> DataFrame:
        return validate.wrong_vertices(self.nodes, self.vertices, boundary=self.boundary, **kind)

    def is_complete(self) -> bool:
        return validate.is_complete(self.vertices, self.infinite_edges, self.dim)


@dataclass
class Integral:
    """Results of a mesh; integrate() updates the cells that changed since the last run."""

    owner: VoronoiMesh
    f: Callable | None = None
    options: integrate.Options = field(default_factory=lambda: integrate.Options(bulk=False, interface=False))
    cells: DataFrame | None = None
    interfaces: DataFrame | None = None
    version: int = -1
    running: bool = False
    source: Integral | None = None
    raw: tuple | None = None

    def integrate(self, algorithm: str | integrate.Algorithm = "fast_polygon", rays: int = 1000, force_source_update: bool = False) -> int:
        """Runs the algorithm and returns the number of cells that were updated.

        With a source, ``heuristic`` takes volumes and areas from it. A source that
        is older than the mesh is an error, or is updated first if that is asked for.
        An ``integrate.Algorithm`` of one's own takes the place of a name.
        """
        if self.running:
            raise RuntimeError("an integral depends on itself")
        self.running = True
        try:
            if self.source is not None and algorithm == "heuristic":
                self.owner._built()
                if self.source.version != self.owner.version:
                    if not force_source_update:
                        raise RuntimeError("the source of the heuristic is out of date")
                    self.source.integrate()
                return self._from_source()
            return self._run(algorithm, rays)
        finally:
            self.running = False

    def _from_source(self) -> int:
        if self.f is None:
            raise ValueError("the heuristic needs an integrand, as an expression")
        if self.version == self.owner.version:
            return 0
        m = self.owner
        bounded = self.source.interfaces.filter(F.col("area") < float("inf"))
        self.cells, self.interfaces = integrate.heuristic_mc(m.nodes, m.vertices, self.source.cells, bounded, m.dim, self.f, m.boundary)
        self.cells, self.interfaces, self.version = self.cells.persist(), self.interfaces.persist(), m.version
        return self.cells.count()

    def _run(self, algorithm: str | integrate.Algorithm, rays: int) -> int:
        m = self.owner
        m._built()
        if self.version == m.version:
            return 0
        d = m.dim
        fresh = self.cells is None or m.changed is None
        todo = m.nodes.select("id") if fresh else settled(m.changed.join(m.nodes.select("id"), "id", "left_semi"))
        alive = m.nodes.select(F.col("id").alias("cell"))
        mine = todo.select(F.col("id").alias("cell"))

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            """Results with the new ones in the place of those of changed cells."""
            return new if fresh else settled(old.join(alive, "cell", "left_semi").join(mine, "cell", "left_anti").unionByName(new))

        if algorithm in ("monte_carlo", "heuristic_mc"):
            own = m.neighbours().join(mine, "cell", "left_semi")
            raw = integrate.monte_carlo(m.nodes, own, m.boundary, d, rays, self.f if algorithm == "monte_carlo" else None)
            # Sides are averaged over all cells: what an unchanged cell was cast to is kept for that.
            self.raw = tuple(merged(old, settled(new)) for old, new in zip(self.raw or raw, raw, strict=True))
            cells, interfaces = integrate.symmetrised(m.nodes, *self.raw, d)
            if algorithm == "heuristic_mc":
                if self.f is None:
                    raise ValueError("heuristic_mc needs an integrand")
                cells, interfaces = integrate.heuristic_mc(m.nodes, m.vertices, cells, interfaces, d, self.f, m.boundary)
            whole = True
        elif isinstance(algorithm, integrate.Algorithm):
            cells, interfaces = integrate.custom(algorithm, m.nodes, m.vertices, todo)
            whole = fresh
        else:
            rows = settled(integrate.exact(m.nodes, m.vertices, self.f, algorithm, None if fresh else todo))
            cells = rows.filter("neighbour is null").select("cell", F.col("measure").alias("volume"), F.col("integral").alias("bulk"))
            interfaces = rows.filter("neighbour is not null").select("cell", "neighbour", F.col("measure").alias("area"), "integral")
            whole = fresh
        if not m.infinite_edges.isEmpty():
            size = cells.select(F.max(F.size("bulk"))).first()[0] or 0 if self.f is not None else 0
            cells, interfaces = integrate.finalised(cells, interfaces, m.infinite_edges, m.neighbours(), size)
            if not whole:
                cells, interfaces = cells.join(mine, "cell", "left_semi"), interfaces.join(mine, "cell", "left_semi")
        if not whole:
            cells, interfaces = merged(self.cells, cells), merged(self.interfaces, interfaces)
        before = self.cells, self.interfaces
        self.cells, self.interfaces, self.version = cells.persist(), interfaces.persist(), m.version
        released(*before)
        return todo.count()

    def kept(self) -> tuple[DataFrame, DataFrame]:
        """Results by the storage options."""
        o = self.options
        c = ["cell", *(["volume"] if o.volume else []), *(["bulk"] if o.bulk else [])]
        i = ["cell", "neighbour", *(["area"] if o.area else []), *(["integral"] if o.interface else [])]
        return self.cells.select(*c), self.interfaces.select(*i)
