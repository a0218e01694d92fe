"""Cell volumes, interface areas and function integrals.

``fast_polygon`` and ``polygon`` are exact for constants: a k-face is a set of
vertices, its measure is the sum over its sub-faces of measure * height / k. The
first shares each sub-face's result by its vertex set, the second adds
determinants of simplices and is there as a cross-check. ``monte_carlo`` casts a
fixed table of directions from each generator, in DataFrame operations only.
``heuristic`` takes integrals from values at vertices and centres;
``heuristic_mc`` does so with Monte-Carlo geometry.

Results: cells(cell, volume, bulk), interfaces(cell, neighbour, area, integral).
The integrand is a numpy function from points (n, d) to values (n, m), or an
expression from a coords column to an array column where the method is relational.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..plans.boundary import Boundary
from .construct import BROADCAST_NODES, halves
from .mesh import incidence
from .state import settled

_OUT = "cell long, neighbour long, measure double, integral array<double>"


@dataclass
class Options:
    """Which results are kept."""

    volume: bool = True
    area: bool = True
    bulk: bool = True
    interface: bool = True


class _Faces:
    """Faces of one cell, as bit masks of its vertices."""

    def __init__(self, points: np.ndarray, masks: dict[int, int], values: np.ndarray | None, f, determinants: bool):
        self.p, self.masks, self.values, self.f, self.determinants = points, masks, values, f, determinants
        self.plain = False
        self.memo: dict[int, tuple] = {}

    def members(self, mask: int) -> list[int]:
        out = []
        while mask:
            low = mask & -mask
            out.append(low.bit_length() - 1)
            mask ^= low
        return out

    def rank(self, at: list[int]) -> int:
        q = self.p[at[1:]] - self.p[at[0]]
        return int(np.linalg.matrix_rank(q, tol=1e-9 * max(1e-300, np.abs(q).max()) * 100)) if len(at) > 1 else 0

    def face(self, mask: int, k: int):
        """(measure, integral or None, basis, centre, simplices or None) of a k-face."""
        if mask in self.memo:
            return self.memo[mask]
        at = self.members(mask)
        q = self.p[at]
        if k == 1:
            span = q[-1] - q[0]
            size = float(np.linalg.norm(span))
            total = size * (self.values[at[0]] + self.values[at[-1]]) / 2 if self.values is not None else None
            out = (size, total, (span / size if size else span)[None, :], q.mean(axis=0), [q[[0, -1]]] if self.determinants else None)
        else:
            centre = q.mean(axis=0)
            measure, total, cones = 0.0, 0.0, []
            basis = None
            seen = set()
            for other in self.masks.values():
                sub = mask & other
                if sub == mask or sub in seen or sub.bit_count() < k:
                    continue
                seen.add(sub)
                if not self.plain and self.rank(self.members(sub)) != k - 1:
                    continue
                m, i, b, _, s = self.face(sub, k - 1)
                gap = centre - self.p[(sub & -sub).bit_length() - 1]
                gap = gap - (b @ gap) @ b
                height = float(np.linalg.norm(gap))
                measure += m * height / k
                if i is not None:
                    total = total + i * height
                if basis is None and height > 0:
                    basis = np.concatenate([b, gap[None, :] / height])
                if self.determinants:
                    cones += [np.concatenate([x, centre[None, :]]) for x in s]
            if self.determinants:
                measure = sum(_simplex(x) for x in cones)
            total = (total + measure * self.f(centre[None, :])[0]) / (k + 1) if self.values is not None else None
            out = (measure, total, basis if basis is not None else np.zeros((k, self.p.shape[1])), centre, cones if self.determinants else None)
        self.memo[mask] = out
        return out


def _simplex(x: np.ndarray) -> float:
    """Measure of a simplex by the determinant of its Gram matrix."""
    e = x[1:] - x[0]
    return math.sqrt(max(0.0, np.linalg.det(e @ e.T))) / math.factorial(len(e))


def _exact(cell: int, x: np.ndarray, sigmas: list, points: np.ndarray, f, determinants: bool, heuristic: bool):
    d = len(x)
    masks: dict[int, int] = {}
    for v, s in enumerate(sigmas):
        for j in s:
            if j != cell:
                masks[j] = masks.get(j, 0) | 1 << v
    values = f(points) if f is not None else None
    faces = _Faces(points, masks, None if heuristic else values, f, determinants)
    faces.plain = all(len(s) == d + 1 for s in sigmas)
    volume, bulk, rows = 0.0, 0.0, []
    fx = f(x[None, :])[0] if f is not None else None
    for j, mask in masks.items():
        at = faces.members(mask)
        if len(at) < d or not faces.plain and faces.rank(at) != d - 1:
            continue
        if d == 1:
            area, integral, height = 1.0, values[at[0]] if values is not None else None, float(np.linalg.norm(points[at[0]] - x))
        else:
            area, integral, basis, centre, _ = faces.face(mask, d - 1)
            gap = x - points[at[0]]
            height = float(np.linalg.norm(gap - (basis @ gap) @ basis))
            if heuristic and values is not None:
                integral = area * ((d - 1) / d * values[at].mean(axis=0) + f(centre[None, :])[0] / d)
        volume += area * height / d
        if f is not None:
            bulk = bulk + height / d * (area * fx / (d + 1) + integral * d / (d + 1))
        rows.append((cell, j, area, integral.tolist() if integral is not None else None))
    rows.append((cell, None, volume, np.asarray(bulk).tolist() if f is not None else None))
    return rows


class Lattice:
    """Measures and integrals of all faces of a group of cells whose vertices are in general position.

    A k-face is a set of d + 1 - k members that vertices share, so faces of each
    dimension are the distinct subsets of signatures. They are made once for all
    cells of the group, dimension by dimension, from the faces below: a face is
    the sum of the cones from the mean of its vertices over its sub-faces.
    """

    def __init__(self, sigmas: np.ndarray, points: np.ndarray, mine: np.ndarray, f):
        # Members are numbered; mine tells which are cells of the group.
        self.s, self.p, self.mine, self.f = sigmas, points, mine, f
        self.d = points.shape[1]
        self.name = np.random.default_rng(len(mine)).integers(1, 2**63, len(mine), dtype=np.uint64)

    def _faces(self, k: int):
        """(members, vertex rows of the faces in order of face, first row of each, names) of the k-faces of the group's cells."""
        picks = np.array(list(combinations(range(self.d + 1), self.d + 1 - k)))
        sets = self.s[:, picks]
        at, pick = np.nonzero(self.mine[sets].any(axis=2))
        names = self.name[sets[at, pick]].sum(axis=1)
        order = np.argsort(names, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(names[order].view(np.int64)) != 0])) if len(order) else np.zeros(0, np.int64)
        head = order[first]
        return sets[at[head], pick[head]], at[order], first, names[head]

    def _means(self, rows: np.ndarray, first: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[rows], first, axis=0) / np.diff(first, append=len(rows))[:, None]

    def facets(self, heuristic: bool = False):
        """(members, measure, integral or None, basis, a vertex of each) of the facets."""
        d, p = self.d, self.p
        values = self.f(p) if self.f is not None else None
        m, rows, first, names = self._faces(1 if d > 1 else 0)
        a, z = p[rows[first]], p[rows[np.append(first[1:], len(rows)) - 1]] if len(first) else p[:0]
        if d == 1:
            return m, np.ones(len(m)), values[rows[first]] if values is not None else None, np.zeros((len(m), 0, 1)), a
        span = z - a
        size = np.linalg.norm(span, axis=1)
        total = size[:, None] * (values[rows[first]] + values[rows[np.append(first[1:], len(rows)) - 1]]) / 2 if values is not None and not heuristic else None
        basis = (span / np.where(size > 0, size, 1.0)[:, None])[:, None, :]
        for k in range(2, d):
            below = m, names, size, total, basis, a
            m, rows, first, names = self._faces(k)
            centre, a = self._means(rows, first, p), p[rows[first]]
            size, total, basis = self._cones(k, names, centre, below)
        if heuristic and values is not None:
            total = size[:, None] * ((d - 1) / d * self._means(rows, first, values) + self.f(self._means(rows, first, p)) / d)
        return m, size, total, basis, a

    def _cones(self, k: int, names: np.ndarray, centre: np.ndarray, below):
        m, _, small, inner, basis, a = below
        # A face is what is left of a sub-face's members without one of them.
        up = self.name[m].sum(axis=1)[:, None] - self.name[m]
        order = np.argsort(names, kind="stable")
        at = order[np.minimum(np.searchsorted(names[order], up), len(names) - 1)] if len(names) else np.zeros_like(up, dtype=np.int64)
        sub, drop = np.nonzero(names[at] == up) if len(names) else (np.zeros(0, np.int64),) * 2
        face = at[sub, drop]
        gap = centre[face] - a[sub]
        b = basis[sub]
        gap = gap - np.einsum("nij,ni->nj", b, np.einsum("nij,nj->ni", b, gap))
        height = np.linalg.norm(gap, axis=1)
        size = np.bincount(face, small[sub] * height, len(names)) / k
        total = None
        if inner is not None:
            sums = np.stack([np.bincount(face, inner[sub, c] * height, len(names)) for c in range(inner.shape[1])], axis=1)
            total = (sums + size[:, None] * self.f(centre)) / (k + 1)
        # The widest cone gives the face its basis.
        widest = np.lexsort((height, face))
        last = np.flatnonzero(np.append(np.diff(face[widest]) != 0, True)) if len(widest) else widest
        pick = widest[last]
        out = np.zeros((len(names), k, self.d))
        out[face[pick]] = np.concatenate([b[pick], (gap[pick] / np.where(height[pick] > 0, height[pick], 1.0)[:, None])[:, None, :]], axis=1)
        return size, total, out


def _group_rows(cells: np.ndarray, x: np.ndarray, sigmas: np.ndarray, points: np.ndarray, f, heuristic: bool):
    """(cell, neighbour or -2**63, measure, integrals) of all cells of a group; sigmas: names, d + 1 for each vertex."""
    d = x.shape[1]
    names, s = np.unique(sigmas, return_inverse=True)
    s = s.reshape(sigmas.shape)
    place = np.searchsorted(cells, names)
    place = np.where((place < len(cells)) & (cells[np.minimum(place, len(cells) - 1)] == names), place, -1)
    m, size, total, basis, a = Lattice(s, points, place >= 0, f).facets(heuristic)
    both = np.concatenate([m, m[:, ::-1]])
    row = np.concatenate([np.arange(len(m))] * 2)
    keep = place[both[:, 0]] >= 0
    both, row = both[keep], row[keep]
    own = place[both[:, 0]]
    gap = x[own] - a[row]
    gap = gap - np.einsum("nij,ni->nj", basis[row], np.einsum("nij,nj->ni", basis[row], gap))
    height = np.linalg.norm(gap, axis=1)
    volume = np.bincount(own, size[row] * height, len(cells)) / d
    integral = bulk = None
    if f is not None:
        integral, fx = total[row], f(x)
        part = height[:, None] / d * (size[row][:, None] * fx[own] / (d + 1) + integral * d / (d + 1))
        bulk = np.stack([np.bincount(own, part[:, c], len(cells)) for c in range(part.shape[1])], axis=1)
    return np.concatenate([cells[own], cells]), np.concatenate([names[both[:, 1]], np.full(len(cells), np.iinfo(np.int64).min)]), np.concatenate([size[row], volume]), np.concatenate([integral, bulk]) if f is not None else None


def _lists(flat: np.ndarray | None, n: int) -> pa.Array:
    if flat is None:
        return pa.nulls(n, pa.list_(pa.float64()))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1).astype(float), pa.float64()))


#: Cells of a group that are integrated at once.
GROUP_CELLS = 500


def spatial_groups(nodes: DataFrame, size: int = GROUP_CELLS) -> DataFrame:
    """(id, group): groups of about ``size`` near nodes, by a grid; a group may be larger where nodes are dense."""
    n, d = nodes.agg(F.count(F.lit(1)), F.max(F.size("coords"))).first()
    each = max(1, math.ceil(n / max(1, min(size, -(-n // nodes.sparkSession.sparkContext.defaultParallelism)))))
    axes = min(d or 1, max(1, each.bit_length() - 1))
    ends = nodes.agg(*[f(F.col("coords")[k]).alias(f"{f.__name__}{k}") for k in range(axes) for f in (F.min, F.max)]).first()
    parts = [max(1, round(each ** (1 / axes)))] * axes
    group = F.lit(0).cast("long")
    for k in range(axes):
        lo, hi = ends[f"min{k}"] or 0.0, ends[f"max{k}"] or 1.0
        group = group * parts[k] + F.least(F.floor((F.col("coords")[k] - lo) / max(hi - lo, 1e-300) * parts[k]), F.lit(parts[k] - 1))
    return nodes.select("id", group.cast("long").alias("group"))


def exact(nodes: DataFrame, vertices: DataFrame, f: Callable | None = None, method: str = "fast_polygon", cells: DataFrame | None = None) -> DataFrame:
    """(cell, neighbour, measure, integral): areas of interfaces, and volumes where neighbour is null.

    Near cells are integrated together, so that what they share is done once.
    Cells with a vertex of more than d + 1 generators, whose faces aren't told by
    sets of generators, and those of ``polygon`` are done one by one.
    """
    if method not in ("fast_polygon", "polygon", "heuristic"):
        raise ValueError(f"unknown method {method!r}")
    wanted = nodes.select("id", "coords") if cells is None else nodes.select("id", "coords").join(cells.select("id"), "id", "left_semi")
    small = wanted.limit(BROADCAST_NODES + 1).toArrow()
    if len(small) <= BROADCAST_NODES:
        return _exact_small(small, vertices, f, method)
    groups = spatial_groups(wanted)
    rows = incidence(vertices).select("cell", "sigma", "position").join(groups.withColumnRenamed("id", "cell"), "cell")
    rows = rows.select("group", F.lit(None).cast("long").alias("cell"), "sigma", "position").dropDuplicates(["group", "sigma"])
    # A cell's own row comes with its generator; cells without vertices have none of theirs.
    rows = rows.unionByName(wanted.join(groups, "id").select("group", F.col("id").alias("cell"), F.lit(None).cast("array<bigint>").alias("sigma"), F.col("coords").alias("position")))

    def build(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()  # a group of near cells and their vertices
        flat = t["position"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        own = t["cell"].is_valid().to_numpy()
        ids, x = t["cell"].combine_chunks().filter(pa.array(own)).to_numpy(), flat[own]
        order = np.argsort(ids)
        yield from _integrated(ids[order], x[order], t["sigma"].combine_chunks().filter(pa.array(~own)), flat[~own], f, method)

    return rows.groupBy("group").applyInArrow(build, _OUT)


def _exact_small(cells: pa.Table, vertices: DataFrame, f, method: str) -> DataFrame:
    """exact() where the cells (id, coords) fit a broadcast: groups are cut in the driver, and only vertices are shuffled, to the groups that they belong to."""
    spark = vertices.sparkSession
    if not len(cells):
        return spark.createDataFrame([], _OUT)
    ids, x = cells["id"].to_numpy(), cells["coords"].combine_chunks().flatten().to_numpy().reshape(len(cells), -1)
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    parts = halves(x, max(1, min(GROUP_CELLS, -(-len(ids) // spark.sparkContext.defaultParallelism))))
    group = np.zeros(len(ids), np.int64)
    for k, at in enumerate(parts):
        group[at] = k
    shared = spark.sparkContext.broadcast((ids, x, group))

    def deal(batches):
        ids, _, group = shared.value
        for b in batches:
            sigma = b.column("sigma")
            flat, sizes = sigma.flatten().to_numpy(), sigma.value_lengths().to_numpy()
            place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            pairs = np.unique((np.repeat(np.arange(b.num_rows), sizes) * len(parts) + group[place])[ids[place] == flat])
            yield pa.RecordBatch.from_arrays([pa.array(pairs % len(parts)), *b.take(pa.array(pairs // len(parts))).columns], ["group", "sigma", "position"])

    def build(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids, x, group = shared.value
        t = pa.Table.from_batches(held).combine_chunks()  # a group, or several that came to one task
        number = t["group"].to_numpy()
        for k in np.unique(number):
            part = t.filter(pa.array(number == k)).combine_chunks()
            at = np.flatnonzero(group == k)
            yield from _integrated(ids[at], x[at], part["sigma"].combine_chunks(), part["position"].combine_chunks().flatten().to_numpy().reshape(len(part), -1), f, method)

    rows = vertices.select("sigma", "position").mapInArrow(deal, "group long, sigma array<long>, position array<double>")
    return rows.repartitionById(len(parts), F.col("group").cast("int")).mapInArrow(build, _OUT)


def _integrated(ids: np.ndarray, x: np.ndarray, sigma: pa.Array, points: np.ndarray, f, method: str) -> Iterator[pa.RecordBatch]:
    """Results of the cells ``ids``, in order, of a group with its vertices."""
    d = x.shape[1]
    sizes = sigma.value_lengths().to_numpy(zero_copy_only=False) if len(sigma) else np.zeros(0, np.int64)
    odd = set(sigma.filter(pa.array(sizes != d + 1)).flatten().to_pylist())
    one_by_one = np.array([method == "polygon" or i in odd for i in ids.tolist()], bool)
    names = ["cell", "neighbour", "measure", "integral"]
    if (~one_by_one).any():
        plain = sigma.filter(pa.array(sizes == d + 1)).flatten().to_numpy().reshape(-1, d + 1)
        at = ~one_by_one
        touch = np.isin(plain, ids[at]).any(axis=1)
        cell, neighbour, measure, integral = _group_rows(ids[at], x[at], plain[touch], points[sizes == d + 1][touch], f, method == "heuristic")
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(neighbour, mask=neighbour == np.iinfo(np.int64).min), pa.array(measure), _lists(integral, len(cell))], names)
    if one_by_one.any():
        lists = sigma.to_pylist()
        held: dict[int, list[int]] = {}
        for k, s in enumerate(lists):
            for c in s:
                held.setdefault(c, []).append(k)
        for i in np.flatnonzero(one_by_one):
            at = held.get(int(ids[i]), [])
            if at:
                out = _exact(int(ids[i]), x[i], [lists[k] for k in at], points[at], f, method == "polygon", method == "heuristic")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))], names)


class Algorithm:
    """An integration method of one's own. integrate_cell() runs in the tasks; the other hooks run in the driver."""

    def prepare(self, nodes: DataFrame, vertices: DataFrame) -> None:
        """Before anything is integrated."""

    def begin(self, cells: DataFrame) -> None:
        """The cells (id) that will be integrated."""

    def worker(self) -> object:
        """State of a task, made once in it and given to integrate_cell()."""

    def integrate_cell(self, state, cell: int, x: np.ndarray, sigmas: list[list[int]], points: np.ndarray):
        """(volume, values of the bulk or None, list of (neighbour, area, values or None)) of a cell at x with its vertices."""
        raise NotImplementedError

    def cleanup(self, cells: DataFrame, interfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Results as they shall be kept."""
        return cells, interfaces

    def end(self) -> None:
        """After the results are there."""


def custom(algorithm: Algorithm, nodes: DataFrame, vertices: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, interfaces) of the given cells by an algorithm of one's own."""
    algorithm.prepare(nodes, vertices)
    algorithm.begin(cells)
    rows = incidence(vertices).join(cells.select(F.col("id").alias("cell")), "cell", "left_semi").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("sigma", "position"))).alias("v"))
    rows = rows.join(nodes.select(F.col("id").alias("cell"), F.col("coords").alias("x")), "cell")

    def build(batches):
        state = algorithm.worker()
        for b in batches:
            out = []
            for r in b.to_pylist():
                volume, bulk, faces = algorithm.integrate_cell(state, r["cell"], np.array(r["x"]), [v["sigma"] for v in r["v"]], np.array([v["position"] for v in r["v"]]))
                out += [(r["cell"], None, volume, bulk), *((r["cell"], *face) for face in faces)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["cell", "neighbour", "measure", "integral"])

    found = settled(rows.select("cell", "x", "v").mapInArrow(build, _OUT))
    done = algorithm.cleanup(found.filter("neighbour is null").select("cell", F.col("measure").alias("volume"), F.col("integral").alias("bulk")), found.filter("neighbour is not null").select("cell", "neighbour", F.col("measure").alias("area"), "integral"))
    algorithm.end()
    return done


# -- Monte Carlo ---------------------------------------------------------------------------------


def directions(spark: SparkSession, d: int, n: int) -> DataFrame:
    """(ray, u): n fixed unit vectors. Golden-ratio sequences give uniform numbers, Box-Muller normal ones."""
    pairs = (d + 1) // 2
    root = 2.0
    for _ in range(40):
        root = (1 + root) ** (1 / (2 * pairs + 1))
    even = lambda k: F.pmod(F.lit(0.5) + (F.col("id") + 1) * F.lit(root ** -(k + 1)), F.lit(1.0))
    xs = []
    for k in range(pairs):
        r, a = F.sqrt(-2 * F.log(F.greatest(even(2 * k), F.lit(1e-12)))), 2 * math.pi * even(2 * k + 1)
        xs += [r * F.cos(a), r * F.sin(a)]
    return spark.range(n).select(F.col("id").alias("ray"), vec.normalized(vec.point(*xs[:d])).alias("u"))


def ray_hits(nodes: DataFrame, neighbours: DataFrame, boundary: Boundary | None, rays: DataFrame) -> DataFrame:
    """(cell, ray, t, neighbour, slope): where each ray leaves its cell, and the cosine to the interface's normal."""
    n = nodes.select("id", "coords")
    pairs = neighbours.join(n.select(F.col("id").alias("cell"), F.col("coords").alias("x")), "cell")
    sides = pairs.join(n.select(F.col("id").alias("neighbour"), F.col("coords").alias("y")), "neighbour").select("cell", "neighbour", vec.sub("y", "x").alias("d"), (vec.squared_distance("x", "y") / 2).alias("c"))
    if boundary is not None and boundary.planes:
        b = boundary.frame(nodes.sparkSession).select((-1 - F.col("plane")).cast("long").alias("neighbour"), "base", "normal")
        walls = pairs.join(F.broadcast(b), "neighbour").select("cell", "neighbour", F.col("normal").alias("d"), vec.dot(vec.sub("base", "x"), "normal").alias("c"))
        sides = sides.unionByName(walls)
    # A cell's sides are a row; all rays of a cell are cast in its task, and only where they end is sent on.
    table = rays.orderBy("ray").toArrow()  # the fixed directions
    shared = nodes.sparkSession.sparkContext.broadcast((table["ray"].to_numpy(), np.array(table["u"].to_pylist())))
    sides = sides.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("neighbour", "d", "c"))).alias("sides"))

    def cast(batches):
        number, u = shared.value
        for b in batches:
            for k in range(b.num_rows):
                side = b.column("sides")[k].values
                names, c = side.field("neighbour").to_numpy(), side.field("c").to_numpy()
                d = side.field("d").flatten().to_numpy().reshape(len(c), -1)
                slope = u @ d.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(slope > 1e-14, c / slope, np.inf)
                best = t.argmin(axis=1)
                far = t[np.arange(len(u)), best]
                hit = np.isfinite(far)
                best, far = best[hit], far[hit]
                cosine = slope[hit, best] / np.linalg.norm(d, axis=1)[best]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(far), b.column("cell")[k].as_py(), np.int64)), pa.array(number[hit]), pa.array(far), pa.array(names[best]), pa.array(cosine)], ["cell", "ray", "t", "neighbour", "slope"])

    return sides.mapInArrow(cast, "cell long, ray long, t double, neighbour long, slope double")


def monte_carlo(nodes: DataFrame, neighbours: DataFrame, boundary: Boundary | None, d: int, n_rays: int = 1000, f: Callable[[Column], Column] | None = None, samples: int = 100) -> tuple[DataFrame, DataFrame]:
    """(cells, interfaces) from n_rays fixed directions; f: expression from a coords column to an array.

    V = omega mean t^d, A_j = d omega mean t^(d-1) / |n.u| over the rays that leave by j.
    """
    spark = nodes.sparkSession
    rays = directions(spark, d, n_rays)
    hits = ray_hits(nodes, neighbours, boundary, rays)
    omega = vec.unit_ball_volume(d)
    cells = hits.groupBy("cell").agg((F.sum(F.pow("t", F.lit(float(d)))) * omega / n_rays).alias("volume"))
    weight = F.pow("t", F.lit(float(d - 1))) / F.col("slope") * (d * omega / n_rays)
    if f is None:
        return cells.withColumn("bulk", F.lit(None).cast("array<double>")), hits.groupBy("cell", "neighbour").agg(F.sum(weight).alias("area")).withColumn("integral", F.lit(None).cast("array<double>"))
    at = hits.join(nodes.select(F.col("id").alias("cell"), F.col("coords").alias("x")), "cell").join(F.broadcast(rays), "ray")
    size = nodes.select(F.size(f(F.col("coords"))).alias("n")).first()
    size = size["n"] if size is not None else 0
    summed = lambda v: F.array(*[F.sum(F.col("w") * F.col(v)[k]) for k in range(size)])
    face = at.select("cell", "neighbour", weight.alias("w"), f(vec.axpy("x", "t", "u")).alias("v"))
    area = face.groupBy("cell", "neighbour").agg(F.sum("w").alias("area"), summed("v").alias("integral"))
    # Radii at the middle of equal steps, weighted by r^(d-1).
    steps = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: (i - 0.5) / samples)
    inner = at.select("cell", "t", "x", "u", F.explode(steps).alias("r"))
    part = F.pow("t", F.lit(float(d))) * F.pow("r", F.lit(float(d - 1))) * (d * omega / n_rays / samples)
    inner = inner.select("cell", part.alias("w"), f(vec.axpy("x", F.col("t") * F.col("r"), "u")).alias("v"))
    bulk = inner.groupBy("cell").agg(summed("v").alias("bulk"))
    return cells.join(bulk, "cell", "left"), area


def symmetrised(nodes: DataFrame, cells: DataFrame, interfaces: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """Areas as the mean of both sides, unless one is below 1e-10 of the other; volumes follow by change of area * distance / (2 d)."""
    back = interfaces.select(F.col("neighbour").alias("cell"), F.col("cell").alias("neighbour"), F.col("area").alias("other"))
    both = interfaces.join(back, ["cell", "neighbour"], "left")
    mean = F.when(F.col("other").isNull() | (F.least("area", "other") < 1e-10 * F.greatest("area", "other")), F.col("area")).otherwise((F.col("area") + F.col("other")) / 2)
    both = both.withColumn("new", mean)
    x = nodes.select("id", "coords")
    moved = both.filter("neighbour >= 0").join(x.select(F.col("id").alias("cell"), F.col("coords").alias("a")), "cell").join(x.select(F.col("id").alias("neighbour"), F.col("coords").alias("b")), "neighbour")
    change = moved.groupBy("cell").agg(F.sum((F.col("new") - F.col("area")) * vec.distance("a", "b") / (2 * d)).alias("change"))
    out = cells.join(change, "cell", "left").withColumn("volume", F.col("volume") + F.coalesce("change", F.lit(0.0))).drop("change")
    ratio = F.when(F.col("area") > 0, F.col("new") / F.col("area")).otherwise(1.0)
    return out, both.select("cell", "neighbour", F.col("new").alias("area"), F.transform("integral", lambda v: v * ratio).alias("integral"))


def heuristic_mc(nodes: DataFrame, vertices: DataFrame, cells: DataFrame, interfaces: DataFrame, d: int, f: Callable[[Column], Column], boundary: Boundary | None = None) -> tuple[DataFrame, DataFrame]:
    """Integrals from values of f at vertices, their mean point and generators, with the given areas and volumes."""
    shared = incidence(vertices).select("cell", F.explode("sigma").alias("neighbour"), "position").filter("cell <> neighbour")
    each = shared.withColumn("v", f(F.col("position")))
    mean = lambda rows, c, name: rows.select("cell", "neighbour", F.posexplode(c).alias("k", "x")).groupBy("cell", "neighbour", "k").agg(F.avg("x").alias("x")).groupBy("cell", "neighbour").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda t: t["x"]).alias(name))
    at = mean(each, "v", "mean_v").join(mean(shared, "position", "centre"), ["cell", "neighbour"])
    rows = interfaces.drop("integral").join(at, ["cell", "neighbour"])
    values = F.zip_with("mean_v", f(F.col("centre")), lambda a, b: F.col("area") * (a * ((d - 1) / d) + b / d))
    rows = rows.withColumn("integral", values)
    x = nodes.select("id", "coords")
    rows = rows.join(x.select(F.col("id").alias("cell"), F.col("coords").alias("a")), "cell").join(x.select(F.col("id").alias("neighbour"), F.col("coords").alias("b")), "neighbour", "left")
    height = vec.distance("a", "b") / 2
    if boundary is not None and boundary.planes:
        walls = F.array(*boundary.values("a"))
        height = F.when(F.col("neighbour") < 0, F.abs(F.element_at(walls, F.greatest(-F.col("neighbour"), F.lit(1)).cast("int")))).otherwise(height)
    parts = rows.withColumn("h", height).withColumn("fx", f(F.col("a")))
    part = parts.select("cell", F.posexplode(F.zip_with("fx", "integral", lambda p, q: F.col("h") / d * (F.col("area") * p / (d + 1) + q * d / (d + 1)))).alias("k", "x"))
    bulk = part.groupBy("cell", "k").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda t: t["x"]).alias("bulk"))
    return cells.drop("bulk").join(bulk, "cell", "left"), rows.select("cell", "neighbour", "area", "integral")


# -- unbounded cells and change sets -------------------------------------------------------------


def unbounded(infinite_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, pairs): cells with an unbounded edge, and pairs of generators along one."""
    cells = infinite_edges.select(F.explode("sigma").alias("cell")).filter("cell >= 0").distinct()
    pairs = infinite_edges.select(F.explode(F.filter("sigma", lambda s: s >= 0)).alias("cell"), "sigma").select("cell", F.explode("sigma").alias("neighbour")).filter("cell <> neighbour").distinct()
    return cells, pairs


def finalised(cells: DataFrame, interfaces: DataFrame, infinite_edges: DataFrame, neighbours: DataFrame, components: int = 0) -> tuple[DataFrame, DataFrame]:
    """Results with unbounded cells: volume inf, integrals NaN; unbounded interfaces inf and NaN, others as their finite side has them."""
    gone, pairs = unbounded(infinite_edges)
    nan = F.array_repeat(F.lit(float("nan")), components) if components else F.lit(None).cast("array<double>")
    c = cells.join(gone.withColumn("open", F.lit(True)), "cell", "full_outer")
    c = c.select("cell", F.when(F.col("open"), float("inf")).otherwise(F.col("volume")).alias("volume"), F.when(F.col("open"), nan).otherwise(F.col("bulk")).alias("bulk"))
    wide = neighbours.select("cell", "neighbour").join(pairs, ["cell", "neighbour"], "left_semi").withColumn("open", F.lit(True))
    i = interfaces.join(wide, ["cell", "neighbour"], "full_outer")
    i = i.select("cell", "neighbour", F.when(F.col("open"), float("inf")).otherwise(F.col("area")).alias("area"), F.when(F.col("open"), nan).otherwise(F.col("integral")).alias("integral"))
    return c, i


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old results with the new ones in the place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def retargeted(old: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Old interfaces under a new neighbour list (cell, neighbour, occurrence): values stay where the key is still there, others are null."""
    return neighbours.join(old, ["cell", "neighbour", "occurrence"], "left")
