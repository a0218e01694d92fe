"""Planes: oriented half-spaces (x - base).normal <= 0 with a condition, and what they are asked.

A boundary is a small table built in Python; its rows become literals or a
broadcast of as many rows as it has planes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec

SCHEMA = "plane INT, base ARRAY<DOUBLE>, normal ARRAY<DOUBLE>, cond STRING, partner INT"
DIRICHLET, NEUMANN, PERIODIC = "dirichlet", "neumann", "periodic"


@dataclass
class Plane:
    base: np.ndarray
    normal: np.ndarray
    cond: str = DIRICHLET
    partner: int | None = None


@dataclass
class Boundary:
    dim: int
    planes: list[Plane] = field(default_factory=list)

    def add(self, base, normal, cond: str = DIRICHLET) -> Boundary:
        normal = np.asarray(normal, float)
        size = np.linalg.norm(normal)
        if not np.isfinite(size) or size == 0 or len(normal) != self.dim:
            raise ValueError("a plane needs a finite normal that isn't zero, of the boundary's dimension")
        if cond not in (DIRICHLET, NEUMANN, PERIODIC):
            raise ValueError(f"unknown condition {cond!r}")
        self.planes.append(Plane(np.asarray(base, float), normal / size, cond))
        return self

    def add_periodic(self, base_a, base_b, normal) -> Boundary:
        """Two partner planes; the second has the negated normal."""
        a = len(self.planes)
        self.add(base_a, normal, PERIODIC)
        self.add(base_b, -np.asarray(normal, float), PERIODIC)
        self.planes[a].partner, self.planes[a + 1].partner = a + 1, a
        return self

    @classmethod
    def cuboid(cls, lengths, offset=None, periodic: set[int] | None = frozenset(), neumann_low=(), neumann_high=()) -> Boundary:
        """A box, planes per axis in the order upper, lower. periodic: axes, or None for all of them."""
        d = len(lengths)
        low = np.zeros(d) if offset is None else np.asarray(offset, float)
        periodic = set(range(d)) if periodic is None else set(periodic)
        out = cls(d)
        for k in range(d):
            if not lengths[k] > 0:
                raise ValueError("a box needs positive lengths")
            axis = np.eye(d)[k]
            high = low + axis * lengths[k]
            if k in periodic:
                out.add_periodic(high, low, axis)
            else:
                out.add(high, axis, NEUMANN if k in neumann_high else DIRICHLET)
                out.add(low, -axis, NEUMANN if k in neumann_low else DIRICHLET)
        return out

    @classmethod
    def centred_cube(cls, dim: int, half: float, **kind) -> Boundary:
        return cls.cuboid([2 * half] * dim, [-half] * dim, **kind)

    def split_indices(self) -> dict[str, list[int]]:
        """Planes by condition; of a periodic pair both."""
        out = {DIRICHLET: [], NEUMANN: [], PERIODIC: []}
        for i, p in enumerate(self.planes):
            out[p.cond].append(i)
        return out

    def periodic_shift(self, plane: int) -> np.ndarray:
        """What moves a point over the plane to its partner's side."""
        p = self.planes[plane]
        if p.partner is None:
            raise ValueError("not a periodic plane")
        return self.planes[p.partner].base - p.base

    def periodic_pairs(self) -> list[tuple[int, int, np.ndarray]]:
        """(plane, partner, shift), each pair once."""
        return [(i, p.partner, self.periodic_shift(i)) for i, p in enumerate(self.planes) if p.partner is not None and i < p.partner]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, p.base.tolist(), p.normal.tolist(), p.cond, p.partner) for i, p in enumerate(self.planes)]
        return spark.createDataFrame(rows, SCHEMA)

    # -- expressions --

    def values(self, x) -> list[Column]:
        """Signed distance of x to each plane, positive outside."""
        return [vec.dot(vec.sub(x, vec.literal(p.base)), vec.literal(p.normal)) for p in self.planes]

    def contains(self, x, tol: float = 0.0) -> Column:
        out = F.lit(True)
        for v in self.values(x):
            out = out & (v <= tol)
        return out

    def reflect(self, x, plane: int) -> Column:
        return vec.axpy(x, -2 * self.values(x)[plane], vec.literal(self.planes[plane].normal))

    def project(self, x, plane: int) -> Column:
        return vec.axpy(x, -self.values(x)[plane], vec.literal(self.planes[plane].normal))

    def project_inside(self, x, sweeps: int = 16, tol: float = 1e-12) -> Column:
        """x projected on every plane that it is outside of, again and again up to ``sweeps`` times."""
        planes = F.array(*[F.struct(vec.literal(p.base).alias("base"), vec.literal(p.normal).alias("normal")) for p in self.planes])
        rounds = F.flatten(F.array_repeat(planes, sweeps))

        def step(y, p):
            h = vec.dot(vec.sub(y, p["base"]), p["normal"])
            return F.when(h > tol, vec.axpy(y, -h, p["normal"])).otherwise(y)

        return F.aggregate(rounds, F.col(x) if isinstance(x, str) else x, step) if self.planes else x

    def ray_parameters(self, origin, direction) -> list[Column]:
        """Where a ray meets each plane; null where it is parallel."""
        out = []
        for p, v in zip(self.planes, self.values(origin), strict=True):
            slope = vec.dot(direction, vec.literal(p.normal))
            out.append(F.when(F.abs(slope) > 1e-14, -v / slope))
        return out

    def first_intersection(self, origin, direction, min_t: float = 0.0, only: set[int] | None = None) -> Column:
        """Struct (t, plane) of the first plane met beyond min_t, ties to the lowest plane; null if there is none."""
        hits = [F.struct(t.alias("t"), F.lit(i).alias("plane")) for i, t in enumerate(self.ray_parameters(origin, direction)) if only is None or i in only]
        if not hits:
            return F.lit(None).cast("struct<t: double, plane: int>")
        return F.array_min(F.filter(F.array(*hits), lambda h: h["t"].isNotNull() & (h["t"] > min_t)))

    def intersection_point(self, origin, direction, min_t: float = 0.0) -> Column:
        return vec.axpy(origin, self.first_intersection(origin, direction, min_t)["t"], direction)

    def intersection_exists(self, origin, direction, tol: float = 1e-9) -> Column:
        """Whether the first hit lies in the domain."""
        at = self.intersection_point(origin, direction)
        return F.coalesce(self.contains(at, tol), F.lit(False))


def mirror_rows(nodes: DataFrame, boundary: Boundary) -> DataFrame:
    """(cell, plane, coords): each node's reflection in each plane, as many rows per node as there are planes."""
    images = F.array(*[F.struct(F.lit(i).alias("plane"), boundary.reflect("coords", i).alias("coords")) for i in range(len(boundary.planes))])
    return nodes.select(F.col("id").alias("cell"), F.explode(images).alias("m")).select("cell", "m.plane", "m.coords")


def check_nodes(nodes: DataFrame, boundary: Boundary, tol: float = 1e-12) -> DataFrame:
    """The nodes; the query fails on one that is outside the domain."""
    return nodes.filter(F.when(boundary.contains("coords", tol), True).otherwise(F.raise_error(F.lit("a node is outside the domain")).cast("boolean")))


def bounding_box(nodes: DataFrame, boundary: Boundary) -> DataFrame:
    """(axis, low, high) of the nodes and their single reflections."""
    rows = nodes.select("coords")
    if boundary.planes:
        rows = rows.union(mirror_rows(nodes, boundary).select("coords"))
    return rows.select(F.posexplode("coords").alias("axis", "x")).groupBy("axis").agg(F.min("x").alias("low"), F.max("x").alias("high"))
