"""Construction of Voronoi tables from generators and planes.

Cells are built in groups of near ones, a kernel call for each, so that vertices that
they share are made once. Where the generators fit ``BROADCAST_NODES`` rows they are
broadcast, and cells need no shuffle at all: groups come from cutting the points in
halves again and again. Beyond, space is cut to bins: a bin's task gets its own cells
and the generators within a margin around. A cell is certified if the ball of twice
its farthest vertex lies in what was seen; others are tried again with a wider margin.

Tables: vertices(sigma, position), infinite_edges(sigma, origin, direction). sigma
is sorted; boundary planes appear as -1 - plane. A vertex is emitted by the cell of
its smallest generator only, so that no duplicates arise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.boundary import Boundary
from .kernel import TOL, Group, NoVertex, Walk, reach_of

BROADCAST_NODES = 200_000
#: Cells of a group by dimension, and generators up to which a group looks at all of them.
GROUP_CELLS, ALL_SEEN = {1: 4000, 2: 2000, 3: 600, 4: 250}, 4096
SCHEMA = "cell long, kind string, sigma array<long>, position array<double>, direction array<double>"


def _arrays(boundary: Boundary | None, d: int) -> tuple[np.ndarray, np.ndarray]:
    planes = boundary.planes if boundary is not None else []
    return np.array([p.base for p in planes]).reshape(-1, d), np.array([p.normal for p in planes]).reshape(-1, d)


def _lists(flat: np.ndarray, sizes, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.reshape(-1), kind))


def _batch(cell, kind: str, sigma: np.ndarray, sizes, position: np.ndarray, direction: np.ndarray | None = None) -> pa.RecordBatch:
    n, d = len(cell), position.shape[1] if len(position) else 0
    direction = _lists(direction, np.full(n, d), pa.float64()) if direction is not None else pa.nulls(n, pa.list_(pa.float64()))
    columns = [pa.array(cell, pa.int64()), pa.array([kind] * n, pa.string()), _lists(sigma, sizes, pa.int64()), _lists(position, np.full(n, d), pa.float64()), direction]
    return pa.RecordBatch.from_arrays(columns, ["cell", "kind", "sigma", "position", "direction"])


def _named(s: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sorted names of members: ids of generators, -1 - plane of planes."""
    n = len(ids)
    return np.sort(np.where(s < n, ids[np.minimum(s, n - 1)], n - 1 - s), axis=-1)


def _emit(group: Group, ids: np.ndarray, cells: np.ndarray, all_of: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the cells (ids): of each vertex and unbounded edge one for its smallest generator, or for each (all_of)."""
    wanted = np.sort(cells)
    if not len(wanted):
        return

    def rows(names: np.ndarray):
        """(row, cell) of what is emitted."""
        if not all_of:
            names = np.where(names >= 0, names, np.iinfo(np.int64).max).min(axis=1)[:, None]
        at = np.minimum(np.searchsorted(wanted, names), len(wanted) - 1)
        return np.nonzero(wanted[at] == names)[0], names[wanted[at] == names]

    if len(group.plain):
        names = _named(group.plain, ids)
        at, cell = rows(names)
        if len(at):
            yield _batch(cell, "vertex", names[at], np.full(len(at), names.shape[1]), group.points[at])
    wide = [("vertex", s, p, None) for s, p in zip(group.wide, group.wide_points, strict=True)] + [("edge", *r) for r in group.rays]
    for kind in ("vertex", "edge"):
        out = []
        for k, s, p, u in wide:
            if k == kind:
                names = _named(s, ids)
                out += [(c, names, p, u) for c in rows(names[None, :])[1]]
        if out:
            u = np.array([r[3] for r in out]) if kind == "edge" else None
            yield _batch([r[0] for r in out], kind, np.concatenate([r[1] for r in out]), [len(r[1]) for r in out], np.array([r[2] for r in out]), u)


def halves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the points in groups of near ones, of ``size`` at most: cut at the middle of the longest side, again and again."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        x = points[at]
        order = at[np.argsort(x[:, int(np.ptp(x, axis=0).argmax())], kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


def _near(own: np.ndarray, points: np.ndarray, bases, normals, tol: float) -> Iterator[tuple[Group, np.ndarray, np.ndarray]]:
    """(cells, places of the generators seen, certified own cells) until all own cells are done; a group sees more of the generators each time."""
    n, d = points.shape
    seen = n if n <= ALL_SEEN else 40 * 4 ** min(d, 5) + 4 * len(own)
    while len(own):
        if seen >= n:
            at, room = np.arange(n), np.inf
        else:
            centre = points[own].mean(axis=0)
            far = np.linalg.norm(points - centre, axis=1)
            at = np.argpartition(far, seen)[: seen + 1]
            room = far[at].max()
            at = np.union1d(at, own)
        place = np.searchsorted(at, own)
        try:
            group = Walk(place, points[at], bases, normals, tol).cells()
        except NoVertex:
            if seen >= n:
                raise
            seen *= 4
            continue
        if seen >= n:
            yield group, at, own
            return
        sure = np.linalg.norm(points[own] - centre, axis=1) + reach_of(group, place, points[at]) <= room
        yield group, at, own[sure]
        own, seen = own[~sure], 4 * seen


def dimension(nodes: DataFrame) -> int:
    """The one length of all coords; raises if there are several, or coincident or non-finite points."""
    r = nodes.agg(F.min(F.size("coords")), F.max(F.size("coords")), F.count(F.lit(1)), F.count_distinct("coords"), F.max(F.exists("coords", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))).first()
    if r[2] == 0:
        raise ValueError("there are no generators")
    if r[0] != r[1] or r[0] < 1:
        raise ValueError("generators must have one dimension, 1 at least")
    if r[4]:
        raise ValueError("generators must be finite")
    if r[3] != r[2]:
        raise ValueError("two generators coincide")
    return r[0]


def gathered(nodes: DataFrame, most: int | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, points) of a node table of ``most`` rows at most, checked as dimension() does; None for a larger one."""
    rows = nodes.select("id", "coords")
    got = (rows if most is None else rows.limit(most + 1)).toArrow()
    if most is not None and len(got) > most:
        return None
    coords = got["coords"].combine_chunks()
    sizes = np.unique(coords.value_lengths().to_numpy(zero_copy_only=False))
    if not len(got):
        raise ValueError("there are no generators")
    if len(sizes) != 1 or not sizes[0] >= 1:
        raise ValueError("generators must have one dimension, 1 at least")
    points = coords.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1)
    if not np.isfinite(points).all():
        raise ValueError("generators must be finite")
    if len(np.unique(points, axis=0)) != len(points):
        raise ValueError("two generators coincide")
    return got["id"].to_numpy(), points


def cell_rows(nodes: DataFrame, boundary: Boundary | None = None, cells: DataFrame | None = None, tol: float = TOL, strategy: str = "auto", all_of: bool = False) -> DataFrame:
    """Vertices and unbounded edges of the cells in ``cells`` (id; all by default) among ``nodes`` (id, coords).

    all_of: each cell emits all of its vertices, not only those it owns.
    """
    spark = nodes.sparkSession
    small = None if strategy == "bins" else gathered(nodes, None if strategy == "broadcast" else BROADCAST_NODES)
    if small is not None:
        ids, points = small
        n, d = points.shape
        bases, normals = _arrays(boundary, d)
        order = np.argsort(ids)
        ids, points = ids[order], points[order]
        own = np.arange(n) if cells is None else np.flatnonzero(np.isin(ids, cells.select("id").distinct().toArrow()["id"].to_numpy()))
        if not len(own):
            return spark.createDataFrame([], SCHEMA)
        wide = max(1, min(GROUP_CELLS.get(d, 125), -(-len(own) // spark.sparkContext.defaultParallelism)))
        groups = [own[g] for g in halves(points[own], wide)]
        shared = spark.sparkContext.broadcast((ids, points, groups))

        def build(batches):
            ids, points, groups = shared.value
            for b in batches:
                for k in b.column(0).to_pylist():
                    for group, at, sure in _near(groups[k], points, bases, normals, tol):
                        yield from _emit(group, ids[at], ids[sure], all_of)

        return spark.range(0, len(groups), 1, len(groups)).mapInArrow(build, SCHEMA)
    d, n = dimension(nodes), nodes.count()
    bases, normals = _arrays(boundary, d)
    own = nodes.select("id", "coords")
    if cells is not None:
        own = own.join(cells.select("id").distinct(), "id", "left_semi")
    return _by_bins(own, nodes, n, d, bases, normals, tol, all_of)


def _by_bins(own: DataFrame, nodes: DataFrame, n: int, d: int, bases, normals, tol: float, all_of: bool, per_bin: int = 2048) -> DataFrame:
    """Bins of about per_bin generators; a generator goes to the bins that lie within a margin of it, a few mean distances at first."""
    box = nodes.select(F.posexplode("coords").alias("axis", "x")).groupBy("axis").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("axis").collect()
    lo, hi = np.array([r["lo"] for r in box]), np.array([r["hi"] for r in box])
    span = max(float((hi - lo).max()), 1e-300)
    side = span / max(1.0, math.floor((n / per_bin) ** (1 / d)))
    margin = 3 * side / per_bin ** (1 / d)
    at = lambda x, axis, by=0.0: F.floor((x - float(lo[axis]) + by) / side)
    out, left = None, own.withColumn("bin", F.array(*[at(F.col("coords")[k], k) for k in range(d)]))
    while True:
        cover = margin >= span
        spread = nodes.select("id", "coords", F.array().cast("array<bigint>").alias("bin"))
        for axis in range(d):
            x = F.col("coords")[axis]
            spread = spread.withColumn("step", F.explode(F.sequence(at(x, axis, -margin), at(x, axis, margin)))).withColumn("bin", F.concat("bin", F.array("step"))).drop("step")
        wanted = left.select("bin").distinct()
        seen = spread.join(wanted, "bin", "left_semi").select("bin", "id", "coords", F.lit(False).alias("own"))
        build = _bin_builder(margin, cover, lo, hi, side, d, bases, normals, tol, all_of)
        made = left.select("bin", "id", "coords", F.lit(True).alias("own")).unionByName(seen).groupBy("bin").applyInArrow(build, SCHEMA).persist()
        done = made.filter("kind <> 'retry'")
        out = done if out is None else out.unionByName(done)
        again = made.filter("kind = 'retry'").select(F.col("cell").alias("id"))
        if cover or again.isEmpty():
            return out
        left = left.join(again, "id", "left_semi")
        margin *= 2


def _bin_builder(margin: float, cover: bool, lo, hi, side: float, d: int, bases, normals, tol: float, all_of: bool):
    def build(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))  # a bin and its margin
        ids, mine = t["id"].to_numpy(), t["own"].to_numpy()
        points = t["coords"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        wanted = ids[mine]
        ids, points = ids[~mine], points[~mine]
        order = np.argsort(ids)
        ids, points = ids[order], points[order]
        own = np.searchsorted(ids, wanted)
        at = np.array(keys[0].as_py())
        low, high = lo + at * side - margin, lo + (at + 1) * side + margin
        # Beyond what was seen, on a side where the generators end, there is nothing to see.
        x = points[own]
        room = np.minimum(np.where(low <= lo, np.inf, x - low), np.where(high > hi, np.inf, high - x)).min(axis=1)
        try:
            group = Walk(own, points, bases, normals, tol).cells()
            sure = np.full(len(own), True) if cover else reach_of(group, own, points) <= room
            yield from _emit(group, ids, ids[own[sure]], all_of)
        except NoVertex:
            if cover:
                raise
            sure = np.zeros(len(own), bool)
        if not sure.all():
            lost = ids[own[~sure]]
            yield pa.RecordBatch.from_arrays([pa.array(lost), pa.array(["retry"] * len(lost)), *(pa.nulls(len(lost), pa.list_(k)) for k in (pa.int64(), pa.float64(), pa.float64()))], ["cell", "kind", "sigma", "position", "direction"])

    return build


def vertices(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'vertex'").select("sigma", "position")


def infinite_edges(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'edge'").select("sigma", F.col("position").alias("origin"), "direction")


#: Fixed value: the seed of the benchmark's points.
BENCH_SEED = 0x485642454E434835


def splitmix_points(n: int, d: int, seed: int = BENCH_SEED) -> np.ndarray:
    """Points in the unit cube from the SplitMix64 generator."""
    k = np.arange(1, n * d + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + k * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) * 2.0**-53).reshape(n, d)


def engine(spark: SparkSession, name: str, **options) -> DataFrame:
    """Nodes of a registered engine (a Python data source) as a node table."""
    from ..sources.tables import CuboidSource, nodes

    spark.dataSource.register(CuboidSource)
    return nodes(spark.read.format(name).options(**options).load(), "id", "coords")
