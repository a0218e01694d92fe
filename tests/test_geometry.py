"""Construction, relations, integration and validation against closed forms and each other."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polycell.api import Integral, VoronoiMesh
from polycell.functions import vec
from polycell.operators import construct, integrate, kernel, mesh, search, validate
from polycell.operators.periodic import PeriodicMesh, missing_references
from polycell.operators.spherical import SphericalMesh
from polycell.plans import boundary as bd
from polycell.plans.boundary import Boundary
from polycell.sources import tables


def points(spark, rows):
    return tables.from_points(spark, rows).repartition(3)


def grid(n, low, step, d):
    return [[low + step * k for k in t] for t in itertools.product(range(n), repeat=d)]


def spread(n, d, low, high, gap, seed=0):
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        p = rng.uniform(low, high, d)
        if all(np.linalg.norm(p - q) >= gap for q in out):
            out.append(p)
    return out


def sigmas(df):
    return {tuple(r["sigma"]) for r in df.select("sigma").collect()}


# -- construction --


def test_three_open_cells(spark):
    m = VoronoiMesh.from_df(points(spark, [(0, 0), (2, 0), (0, 2)]))
    assert sigmas(m.vertices) == {(0, 1, 2)} and sigmas(m.infinite_edges) == {(0, 1), (0, 2), (1, 2)}
    assert m.is_complete()
    assert not validate.is_complete(m.vertices, m.infinite_edges.filter("sigma <> array(0L, 1L)"), 2)


def test_cross_has_one_bounded_cell(spark):
    m = VoronoiMesh.from_df(points(spark, [(1, 0), (-1, 0), (0, 1), (0, -1), (0, 0)]))
    assert m.infinite_edges.count() == 4
    i = Integral(m, lambda x: np.ones((len(x), 1)), integrate.Options())
    i.integrate()
    v = {r["cell"]: (r["volume"], r["bulk"]) for r in i.cells.collect()}
    assert v[4][0] == pytest.approx(1) and v[4][1][0] == pytest.approx(1)
    assert all(v[k][0] == math.inf and math.isnan(v[k][1][0]) for k in range(4))
    assert i.interfaces.filter(F.col("area") == math.inf).count() == 8


def test_degenerate_grid_has_all_vertices(spark):
    m = VoronoiMesh.from_df(points(spark, grid(4, -0.75, 0.5, 3)), Boundary.centred_cube(3, 1.0))
    assert m.vertices.count() == 125
    assert m.wrong_vertices(max_variance=1e-18).isEmpty()


def test_small_grid_integrals(spark):
    m = VoronoiMesh.from_df(points(spark, grid(2, 0.25, 0.5, 3)), Boundary.cuboid([1.0] * 3))
    f = lambda x: np.stack([np.ones(len(x)), 1 + 2 * x[:, 0] + 3 * x[:, 1] + 4 * x[:, 2]], axis=1)
    i = Integral(m, f, integrate.Options())
    assert i.integrate() == 8
    cells, faces = i.cells.toPandas(), i.interfaces.toPandas()
    assert np.allclose(cells.volume, 1 / 8) and np.allclose(faces.area, 1 / 4) and len(faces) == 48
    assert np.allclose([b[0] for b in cells.bulk], 1 / 8) and np.allclose([x[0] for x in faces.integral], 1 / 4)
    assert sum(b[1] for b in cells.bulk) == pytest.approx(5.5)
    assert i.integrate() == 0


@pytest.mark.parametrize("d,n", [(1, 7), (2, 40), (3, 30), (4, 16)])
def test_volumes_add_up_and_methods_agree(spark, d, n):
    rng = np.random.default_rng(d)
    m = VoronoiMesh.from_df(points(spark, rng.uniform(0.05, 0.95, (n, d))), Boundary.cuboid([1.0] * d))
    f = lambda x: np.stack([np.ones(len(x)), x[:, 0]], axis=1)
    got = {}
    for method in ("fast_polygon", "polygon", "heuristic"):
        i = Integral(m, f, integrate.Options())
        i.integrate(method)
        got[method] = i.cells.toPandas().sort_values("cell"), i.interfaces.toPandas().sort_values(["cell", "neighbour"])
    c, faces = got["fast_polygon"]
    assert c.volume.sum() == pytest.approx(1, abs=2e-9) and (c.volume > 0).all()
    assert sum(b[0] for b in c.bulk) == pytest.approx(1, abs=1e-8)
    for method in ("polygon", "heuristic"):
        assert np.allclose(got[method][0].volume, c.volume, atol=1e-10) and np.allclose(got[method][1].area, faces.area, atol=1e-10)
    both = faces.merge(faces.rename(columns={"cell": "neighbour", "neighbour": "cell"}), on=["cell", "neighbour"])
    assert np.allclose(both.area_x, both.area_y, atol=1e-9)
    if d > 1:
        assert m.wrong_vertices(max_variance=1e-16).isEmpty()
    if d == 3:
        assert validate.open_edges(m.vertices, m.infinite_edges, d).isEmpty()


def test_bins_equal_broadcast(spark):
    for d, n in ((2, 400), (3, 250)):
        df = points(spark, spread(n, d, -2.8, 2.8, 0.05, d))
        box = Boundary.centred_cube(d, 4.0)
        a = construct.vertices(construct.cell_rows(df, box))
        b = construct.vertices(construct._by_bins(df.select("id", "coords"), df, n, d, *construct._arrays(box, d), 1e-9, False, per_bin=8))
        r = validate.compare(a, b).first()
        assert (r["missing_left"], r["missing_right"], r["moved"]) == (0, 0, 0)
    df = points(spark, spread(60, 2, 0, 1, 0.02))
    a, b = construct.cell_rows(df), construct._by_bins(df.select("id", "coords"), df, 60, 2, np.zeros((0, 2)), np.zeros((0, 2)), 1e-9, False, per_bin=8)
    assert sigmas(construct.infinite_edges(a)) == sigmas(construct.infinite_edges(b))


def test_groups_that_see_some_generators_equal_bins(spark, monkeypatch):
    """More generators than a group looks at: cells are certified by what was seen, or tried again."""
    rng = np.random.default_rng(8)
    df = points(spark, rng.random((4500, 2)) ** 2)
    box = Boundary.cuboid([1.0, 1.0])
    monkeypatch.setattr(construct, "GROUP_CELLS", {2: 60})
    a, b = construct.vertices(construct.cell_rows(df, box)), construct.vertices(construct.cell_rows(df, box, strategy="bins"))
    r = validate.compare(a, b).first()
    assert a.count() == 2 * 4500 + 2 and (r["missing_left"], r["missing_right"], r["moved"]) == (0, 0, 0)


def test_integration_of_many_cells_equals_that_of_few(spark, monkeypatch):
    m = VoronoiMesh.from_df(points(spark, spread(60, 3, 0.05, 0.95, 0.05)), Boundary.cuboid([1.0] * 3)).compute()
    key = ["cell", "neighbour"]
    few = integrate.exact(m.nodes, m.vertices).toPandas().sort_values(key)
    monkeypatch.setattr(integrate, "BROADCAST_NODES", 10)
    many = integrate.exact(m.nodes, m.vertices).toPandas().sort_values(key)
    some = integrate.exact(m.nodes, m.vertices, cells=m.nodes.filter("id < 30")).toPandas().sort_values(key)
    assert few[key].astype(float).fillna(-99).values.tolist() == many[key].astype(float).fillna(-99).values.tolist() and np.allclose(few.measure, many.measure)
    assert np.allclose(some.measure, few[few.cell < 30].measure)


def test_degenerate_boundary(spark):
    plane = Boundary(3).add([0, 0, -1], [0, 0, -1])
    m = VoronoiMesh.from_df(points(spark, [(0, 0, 0), (2, 0, 0), (0, 2, 0), (2, 2, 0)]), plane)
    v = m.vertices.collect()
    assert [tuple(r["sigma"]) for r in v] == [(-1, 0, 1, 2, 3)] and np.allclose(v[0]["position"], (1, 1, -1))
    got = {(r["cell"], r["neighbour"]) for r in m.neighbours().collect()}
    assert {n for c, n in got if c == 0} == {-1, 1, 2} and {(r["cell"], r["adjacent"]) for r in m.adjacency().collect()} == {(a, b) for a in range(4) for b in range(4) if a != b}


def test_centre_of_a_grid(spark):
    m = VoronoiMesh.from_df(points(spark, grid(3, 0, 1, 3)))
    assert m.neighbours().filter("cell = 13").count() == 6 and m.adjacency().filter("cell = 13").count() == 26


def test_bad_input_raises(spark):
    with pytest.raises(ValueError, match="coincide"):
        VoronoiMesh.from_df(points(spark, [(0, 0), (0, 0), (1, 1)])).compute()
    with pytest.raises(ValueError, match="one dimension"):
        VoronoiMesh.from_df(points(spark, [(0, 0), (1,)])).compute()
    with pytest.raises(ValueError, match="no generators"):
        VoronoiMesh.from_df(points(spark, [(0, 0)]).limit(0)).compute()
    with pytest.raises(Exception, match="outside"):
        VoronoiMesh.from_df(points(spark, [(0, 0), (3, 3)]), Boundary.cuboid([1.0, 1.0])).compute()
    with pytest.raises(kernel.NoVertex):
        kernel.Walk(np.array([0]), np.array([[0.0, 0.0], [1.0, 0.0]]), np.zeros((0, 2)), np.zeros((0, 2))).cells()


def test_compute_of_some_cells(spark):
    df = points(spark, spread(50, 2, 0, 1, 0.02))
    box = Boundary.cuboid([1.0, 1.0])
    some = construct.cell_rows(df, box, df.filter("id < 5"), all_of=True)
    whole = mesh.incidence(construct.vertices(construct.cell_rows(df, box))).filter("cell < 5")
    assert sigmas(construct.vertices(some)) == sigmas(whole)


# -- increments --


@pytest.mark.parametrize("d,box", [(2, True), (3, True), (2, False)])
def test_increments_equal_fresh_builds(spark, d, box):
    df = points(spark, spread(36, d, -2.4, 2.4, 0.2, d)).persist()
    b = Boundary.centred_cube(d, 4.0) if box else None
    m = VoronoiMesh.from_df(df.filter("id < 25"), b).compute()
    i = Integral(m)
    if box:
        i.integrate()
    report = m.refine(df.filter("id >= 25"))
    fresh = VoronoiMesh.from_df(df, b).compute()
    assert sigmas(m.vertices) == sigmas(fresh.vertices) and sigmas(m.infinite_edges) == sigmas(fresh.infinite_edges)
    assert report.appended.count() == 11 and not report.invalidated.isEmpty()
    m.remove(df.filter("id % 4 = 1"))
    fresh = VoronoiMesh.from_df(df.filter("id % 4 <> 1"), b).compute()
    assert sigmas(m.vertices) == sigmas(fresh.vertices) and sigmas(m.infinite_edges) == sigmas(fresh.infinite_edges)
    if box:
        j = Integral(fresh)
        i.integrate(), j.integrate()
        a, c = i.cells.toPandas().sort_values("cell"), j.cells.toPandas().sort_values("cell")
        assert a.cell.tolist() == c.cell.tolist() and np.allclose(a.volume, c.volume) and i.integrate() == 0


def test_a_cospherical_insert_extends_the_vertex(spark):
    m = VoronoiMesh.from_df(points(spark, [(1, 1), (-1, 1), (1, -1)]), Boundary.centred_cube(2, 3.0)).compute()
    m.refine(tables.from_points(spark, [(-1, -1)], 3))
    fresh = VoronoiMesh.from_df(points(spark, [(1, 1), (-1, 1), (1, -1), (-1, -1)]), Boundary.centred_cube(2, 3.0))
    assert sigmas(m.vertices) == sigmas(fresh.vertices) and (0, 1, 2, 3) in sigmas(m.vertices)


def test_a_stream_of_updates(spark, tmp_path):
    from polycell.streaming.updates import SCHEMA, follow

    pts = spread(20, 2, 0.05, 0.95, 0.05)
    m = VoronoiMesh.from_df(points(spark, pts[:15]), Boundary.cuboid([1.0, 1.0])).compute()
    rows = [("insert", 15 + k, [float(x) for x in p]) for k, p in enumerate(pts[15:])] + [("remove", 3, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    follow(m, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    fresh = VoronoiMesh.from_df(points(spark, pts).filter("id <> 3"), Boundary.cuboid([1.0, 1.0])).compute()
    assert sigmas(m.vertices) == sigmas(fresh.vertices)


def test_a_stream_goes_on_from_its_store(spark, tmp_path):
    from polycell.sources import store
    from polycell.streaming.updates import SCHEMA, follow

    pts = spread(24, 2, 0.05, 0.95, 0.05)
    start = lambda: VoronoiMesh.from_df(points(spark, pts[:15]), Boundary.cuboid([1.0, 1.0])).compute()
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    kept = str(tmp_path / "meshes")
    put([("insert", 15 + k, [float(x) for x in p]) for k, p in enumerate(pts[15:20])])
    follow(start(), stream(), str(tmp_path / "ck"), kept).awaitTermination()
    # Another process would begin like this: with the first mesh, the checkpoint and the store.
    put([("insert", 20 + k, [float(x) for x in p]) for k, p in enumerate(pts[20:])] + [("remove", 3, None)])
    query = follow(start(), stream(), str(tmp_path / "ck"), kept)
    query.awaitTermination()
    fresh = VoronoiMesh.from_df(points(spark, pts).filter("id <> 3"), Boundary.cuboid([1.0, 1.0])).compute()
    assert sigmas(query.followed.mesh.vertices) == sigmas(fresh.vertices)
    version, back = store.read_mesh(spark, kept)
    assert version == 1 and sigmas(back.vertices) == sigmas(fresh.vertices)
    pairs = lambda m: {(r["cell"], r["neighbour"]) for r in m.neighbours().collect()}
    assert pairs(back) == pairs(fresh)
    # A version without its mark isn't there.
    (tmp_path / "meshes" / "v9" / "nodes").mkdir(parents=True)
    assert store.versions(spark, kept)[-1] == 1


def test_stored_results(spark, tmp_path):
    from polycell.sources import store

    m = VoronoiMesh.from_df(points(spark, spread(12, 2, 0.05, 0.95, 0.05)), Boundary.cuboid([1.0, 1.0])).compute()
    i = Integral(m, None, integrate.Options(bulk=False, interface=False))
    i.integrate()
    store.write_integral(i, str(tmp_path / "r"), 0)
    _, back = store.read_integral(spark, str(tmp_path / "r"), m)
    assert back.integrate() == 0 and back.cells.agg(F.sum("volume")).first()[0] == pytest.approx(1)
    wide = store.retarget(back.interfaces, m.neighbours().union(spark.createDataFrame([(0, 99)], "cell long, neighbour long")))
    assert wide.filter("area is null").count() == 1


def test_incremental_monte_carlo_equals_a_fresh_run(spark):
    df = points(spark, spread(30, 2, 0.05, 0.95, 0.05))
    m = VoronoiMesh.from_df(df.filter("id < 27"), Boundary.cuboid([1.0, 1.0])).compute()
    i = Integral(m)
    assert i.integrate("monte_carlo", 200) == 27
    m.refine(df.filter("id >= 27"))
    changed = i.integrate("monte_carlo", 200)
    assert 3 < changed < 30
    j = Integral(VoronoiMesh.from_df(df, Boundary.cuboid([1.0, 1.0])).compute())
    j.integrate("monte_carlo", 200)
    for a, b, keys in ((i.cells, j.cells, ["cell"]), (i.interfaces, j.interfaces, ["cell", "neighbour"])):
        a, b = (x.drop("bulk", "integral").toPandas().sort_values(keys) for x in (a, b))
        assert a[keys].values.tolist() == b[keys].values.tolist() and np.allclose(a.iloc[:, -1], b.iloc[:, -1], atol=1e-12)


def test_counts_of_updated_cells(spark):
    df = points(spark, spread(40, 2, 0.05, 0.95, 0.03))
    m = VoronoiMesh.from_df(df.filter("id < 39")).compute()
    i = Integral(m)
    assert i.integrate() == 39
    report = m.refine(df.filter("id >= 39"))
    want = report.affected.count() + 1
    assert i.integrate() == want < 39 and i.cells.count() == 40
    near = {(r["cell"], r["neighbour"]) for r in m.neighbours().collect()}
    assert near == {(r["cell"], r["neighbour"]) for r in VoronoiMesh.from_df(df).neighbours().collect()}


def test_an_algorithm_of_ones_own(spark):
    class Corners(integrate.Algorithm):
        """Volume: number of vertices; areas: vertices shared."""

        def __init__(self):
            self.calls = []

        def prepare(self, nodes, vertices):
            self.calls.append("prepare")

        def begin(self, cells):
            self.calls.append("begin")

        def integrate_cell(self, state, cell, x, sigmas, points):
            others = sorted({s for t in sigmas for s in t} - {cell})
            return float(len(points)), [1.0], [(o, float(sum(o in t for t in sigmas)), None) for o in others]

        def cleanup(self, cells, interfaces):
            self.calls.append("cleanup")
            return cells, interfaces.filter("neighbour >= 0")

        def end(self):
            self.calls.append("end")

    m = VoronoiMesh.from_df(points(spark, grid(2, 0.25, 0.5, 2)), Boundary.cuboid([1.0, 1.0]))
    own, i = Corners(), Integral(m, None, integrate.Options())
    assert i.integrate(own) == 4 and own.calls == ["prepare", "begin", "cleanup", "end"]
    assert {r["volume"] for r in i.cells.collect()} == {4.0} and i.interfaces.filter("neighbour < 0").isEmpty()


def test_meshes_are_compared_as_a_whole(spark):
    df = points(spark, spread(15, 2, 0.05, 0.95, 0.05))
    box = Boundary.cuboid([1.0, 1.0])
    a, b = VoronoiMesh.from_df(df, box).compute(), VoronoiMesh.from_df(df.filter("id < 14"), box).compute()
    same = validate.compare_meshes(a, a).first()
    assert (same["nodes_missing_left"], same["nodes_moved"], same["missing_left"], same["dim_left"], same["dim_right"]) == (0, 0, 0, 2, 2)
    r = validate.compare_meshes(a, b).first()
    assert (r["nodes_left"], r["nodes_right"], r["nodes_missing_right"]) == (15, 14, 1) and r["missing_right"] > 0


# -- periodic and spherical --


def test_periodic_equals_explicit_tiling(spark):
    pts = spread(20, 3, 0.02, 0.98, 0.08)
    m = PeriodicMesh(points(spark, pts), Boundary.cuboid([1.0] * 3, periodic={0, 1})).compute()
    tiled = [np.array(p) + (a, b, 0) for p in pts for a, b in itertools.product((0, -1, 1), repeat=2)]
    t = VoronoiMesh.from_df(points(spark, tiled), Boundary.cuboid([3.0, 3.0, 1.0], [-1.0, -1.0, 0.0]))
    own = mesh.incidence(t.vertices).filter("cell % 9 = 0").select((F.col("cell") / 9).cast("long").alias("cell"), F.transform("position", lambda x: F.round(F.pmod(x + 1e-9, F.lit(1.0)), 6)).alias("p"))
    got = m.public_vertices().select("cell", F.transform("position", lambda x: F.round(F.pmod(x + 1e-9, F.lit(1.0)), 6)).alias("p"))
    key = lambda df: sorted((r["cell"], tuple(r["p"][:2])) for r in df.collect())
    assert key(own) == key(got)


def test_a_periodic_transaction(spark):
    pts = spread(12, 2, 0.02, 0.98, 0.1)
    box = Boundary.cuboid([1.0, 1.0], periodic=None)
    m = PeriodicMesh(points(spark, pts), box).compute()
    m.append(tables.from_points(spark, [(0.008, 0.5)], 12)).stage_removal(spark.range(2, 4).select("id")).compute()
    fresh = PeriodicMesh(points(spark, [*pts, (0.008, 0.5)]).filter("id not in (2, 3)"), box).compute()
    assert sigmas(m.public_vertices()) == sigmas(fresh.public_vertices())
    refs = m.images.filter("kind = 'reference'")
    assert missing_references(refs, refs.limit(0)).count() == refs.count() and missing_references(refs, refs).isEmpty()


def test_a_transaction_builds_only_what_changes(spark):
    pts = spread(60, 2, 0.02, 0.98, 0.05)
    box = Boundary.cuboid([1.0, 1.0], periodic=None)
    m = PeriodicMesh(points(spark, pts), box).compute()
    m.append(tables.from_points(spark, [(0.003, 0.41)], 60)).compute()
    assert 0 < m.report.affected.count() < 20 and m.report.appended.count() == 1 and not m.report.invalidated.isEmpty()
    fresh = PeriodicMesh(points(spark, [*pts, (0.003, 0.41)]), box).compute()
    assert sigmas(m.public_vertices()) == sigmas(fresh.public_vertices())
    m.stage_removal(spark.range(60, 61).select("id")).compute()
    assert m.report.removed.count() == 1 and sigmas(m.public_vertices()) == sigmas(PeriodicMesh(points(spark, pts), box).compute().public_vertices())


def test_periodic_integrals(spark):
    m = PeriodicMesh(points(spark, spread(20, 3, 0.02, 0.98, 0.08)), Boundary.cuboid([1.0] * 3, periodic={0, 1})).compute()
    seen = []

    def f(x):
        assert (x >= -1e-9).all() and (x <= 1 + 1e-9).all()
        return np.stack([np.ones(len(x)), np.cos(2 * np.pi * x[:, 0])], axis=1)

    cells, interfaces = m.integrate(f)
    c, i = cells.toPandas(), interfaces.toPandas()
    assert len(c) == 20 and c.volume.sum() == pytest.approx(1, abs=1e-9) and sum(b[0] for b in c.bulk) == pytest.approx(1, abs=1e-8)
    walls = i[i.neighbour < 0]
    assert walls.area.sum() == pytest.approx(2, abs=1e-9) and walls.other_area.isna().all()
    inner = i[i.neighbour >= 0]
    assert np.allclose(inner.area, inner.other_area, atol=1e-10) and any(any(s) for s in inner["shift"]) and not seen


def test_few_periodic_nodes_widen_the_tiling(spark):
    m = PeriodicMesh(points(spark, [(0.5, 0.5)]), Boundary.cuboid([1.0, 1.0], periodic=None)).compute()
    assert m.public_vertices().count() == 4


def fibonacci(n):
    k = np.arange(n) + 0.5
    z, a = 1 - 2 * k / n, np.pi * (1 + 5**0.5) * k
    return np.stack([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z], axis=1)


def test_sphere(spark):
    m = SphericalMesh(points(spark, fibonacci(20))).compute()
    rows = m.vertices().collect()
    assert len(rows) == 36 and all(abs(np.linalg.norm(r["position"]) - 1) < 1e-9 for r in rows)
    p = fibonacci(20)
    for r in rows:
        d = p @ np.array(r["position"])
        assert set(np.flatnonzero(d > d.max() - 1e-9)) == set(r["sigma"])
    assert m.neighbours().count() == 2 * (3 * 20 - 6)
    more = tables.from_points(spark, np.random.default_rng(0).standard_normal((4, 3)), 20)
    wide = m.refine(more)
    assert wide.vertices().count() == 44 and not m.invalidated(more).isEmpty()
    assert sigmas(wide.remove(more).vertices()) == sigmas(m.vertices())


def test_antipodal_quotient_of_rotations(spark):
    q = np.random.default_rng(3).standard_normal((14, 4))
    q[::2] *= -1
    m = SphericalMesh(points(spark, q[:10]), antipodal=True).compute()
    assert m.inner.count() == 21
    n = m.nodes.collect()
    assert all(next(x for x in r["coords"] if x != 0) > 0 for r in n)
    p = np.array([r["coords"] for r in sorted(n, key=lambda r: r["id"])])
    for r in m.vertices().collect():
        d = np.abs(p @ np.array(r["position"]))
        assert np.allclose(d[list(set(r["sigma"]))], d.max(), atol=1e-9)
    assert m.refine(tables.from_points(spark, q[10:], 10)).vertices().count() > m.vertices().count()
    with pytest.raises(Exception, match="normalised"):
        SphericalMesh(points(spark, [(0, 0, 0), (1, 0, 0)])).compute()


# -- search --


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_search_methods_agree_with_numpy(spark, d):
    rng = np.random.default_rng(d)
    p, q = rng.random((300, d)), rng.random((40, d)) * 1.4 - 0.2
    nodes = points(spark, p)
    asks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, point array<double>")
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    want = {(i, int(j)) for i in range(40) for j in np.argsort(d2[i], kind="stable")[:4]}
    for how in ("brute", "grid"):
        assert {(r["qid"], r["id"]) for r in search.knn(asks, nodes, 4, how).collect()} == want
        got = {(r["qid"], r["id"]) for r in search.inrange(asks, nodes, 0.3, how).collect()}
        assert got == {(i, int(j)) for i, j in zip(*np.nonzero(d2 < 0.3 * 0.3), strict=True)}
    with pytest.raises(ValueError):
        search.inrange(asks, nodes, -1)


def test_range_search_compares_only_near_nodes(spark):
    nodes = points(spark, np.random.default_rng(1).random((50, 2)))
    asks = nodes.select(F.col("id").alias("qid"), F.col("coords").alias("point"), F.array("id").alias("skip"))
    plan = search.inrange(asks, nodes, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "lambda" not in plan
    assert search.inrange(asks, nodes, 0.1).filter("id = qid").isEmpty()


def test_range_search_by_bins_takes_any_radius(spark):
    nodes = points(spark, [(0.0, 0.0), (1e9, -1e9), (1e9, 5.0), (3.0, 4.0)])
    asks = nodes.select(F.col("id").alias("qid"), F.col("coords").alias("point"))
    for radius in (1e-12, 5.0, 5.000001, 2e9, 1e300):
        want = {(r["qid"], r["id"]) for r in search.inrange(asks, nodes, radius, "brute").collect()}
        assert {(r["qid"], r["id"]) for r in search.inrange(asks, nodes, radius, "grid").collect()} == want


def test_range_search_looks_each_bin_up_once(spark):
    nodes = points(spark, np.random.default_rng(7).random((300, 5)))
    nodes = nodes.withColumn("coords", F.transform("coords", lambda x, i: F.when(~((F.col("id") == 5) & (i == 4) | (F.col("id") == 6) & (i == 1)), x)))
    asks = nodes.select(F.col("id").alias("qid"), F.col("coords").alias("point"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("skip"))
    found = search.inrange(asks, nodes, 0.4)
    assert "posexplode" in found._jdf.queryExecution().executedPlan().toString()
    got, want = ({(r["qid"], r["id"]): r["d2"] for r in search.inrange(asks, nodes, 0.4, how).collect()} for how in ("auto", "brute"))
    assert len(got) > 1000 and got == pytest.approx(want, rel=1e-12)


def test_many_nodes_of_many_axes_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(search, "BRUTE_NODES", 100)
    monkeypatch.setattr(search, "CHUNK", 5 * 90, raising=False)
    p = np.random.default_rng(4).random((300, 5))
    nodes = points(spark, p)
    asks = nodes.select(F.col("id").alias("qid"), F.col("coords").alias("point"), F.array("id").alias("skip"))
    found = search.knn(asks, nodes, 3)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    d2 = ((p[:, None] - p[None]) ** 2).sum(2) + np.diag([np.inf] * 300)
    assert {(r["qid"], r["rank"], r["id"]) for r in found.collect()} == {(i, k + 1, int(j)) for i in range(300) for k, j in enumerate(np.argsort(d2[i])[:3])}


def test_inactive_nodes_and_mirrors(spark):
    nodes = points(spark, [(0, 0), (2, 0), (0, 2), (0.4, 0.4), (0.41, 0.4)]).withColumn("active", F.col("id") != 4)
    q = spark.createDataFrame([(0, [0.41, 0.4])], "qid long, point array<double>")
    assert [r["id"] for r in search.knn(q, nodes, 5).orderBy("rank").collect()] == [3, 0, 1, 2]
    mirrors = bd.mirror_rows(nodes.filter("id = 0"), Boundary.cuboid([4.0, 4.0], [-0.3, -0.3]))
    assert search.nn(spark.createDataFrame([(0, [-0.5, 0.0])], "qid long, point array<double>"), search.with_mirrors(nodes, mirrors, 0)).first()["id"] == -2


def test_a_ray_meets_all_cospherical_nodes(spark):
    nodes = points(spark, [(0, 0), (2, 0), (0, 2), (2, 2), (9, 9)])
    rays = spark.createDataFrame([(0, 0, [0.0, 0.0], [0.5**0.5, 0.5**0.5], []), (1, 0, [0.0, 0.0], [-1.0, 0.0], [])], "rid long, start long, origin array<double>, direction array<double>, skip array<long>")
    got = {r["rid"]: r for r in search.ray_cast(rays, nodes).collect()}
    assert got[0]["sigma"] == [0, 1, 2, 3] and np.allclose(got[0]["position"], (1, 1)) and got[1]["sigma"] is None
    assert search.first_hit(rays, nodes).filter("rid = 0").first()["generator"] == 1


def test_first_hits_of_chunks_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(search, "BRUTE_NODES", 100)
    monkeypatch.setattr(search, "CHUNK", 2 * 90, raising=False)
    p, u = np.random.default_rng(5).random((200, 2)), np.array([0.6, 0.8])
    nodes = points(spark, p)
    rays = nodes.select(F.col("id").alias("rid"), F.col("id").alias("start"), F.col("coords").alias("origin"), vec.literal(u).alias("direction"))
    found = search.first_hit(rays, nodes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    d = p[None] - p[:, None]
    slope = d @ u
    t = np.where(slope > 1e-14, (d**2).sum(2) / np.where(slope > 1e-14, 2 * slope, 1), np.inf)
    want = {(i, int(t[i].argmin()) if np.isfinite(t[i].min()) else None) for i in range(200)}
    assert {(r["rid"], r["generator"]) for r in found.collect()} == want


# -- planes --


def test_square_boundary(spark):
    b = Boundary.cuboid([2.0, 2.0])
    df = spark.createDataFrame([([0.5, 0.5],), ([3.0, 0.25],)], "p array<double>").select("p", b.contains("p").alias("inside"), b.project_inside("p").alias("q"), b.first_intersection("p", vec.literal([1, 0])).alias("h"), b.intersection_point("p", vec.literal([1, 0])).alias("at"), b.intersection_exists("p", vec.literal([1, 0])).alias("hits"))
    a, c = df.orderBy(F.col("p")[0]).collect()
    assert a["inside"] and not c["inside"] and c["q"] == [2.0, 0.25] and a["h"]["t"] == 1.5 and a["h"]["plane"] == 0 and a["at"] == [2.0, 0.5] and a["hits"]
    assert [p.cond for p in Boundary.cuboid([1, 1], periodic=None).planes] == ["periodic"] * 4
    assert Boundary.cuboid([1, 1], periodic={0}, neumann_low={1}).split_indices() == {"dirichlet": [2], "neumann": [3], "periodic": [0, 1]}
    for bad in (([0, 0], [0, 0]), ([0, 0], [1, 0], "other")):
        with pytest.raises(ValueError):
            Boundary(2).add(*bad)


def test_monte_carlo_is_near(spark):
    rng = np.random.default_rng(7)
    m = VoronoiMesh.from_df(points(spark, rng.uniform(0.02, 0.98, (12, 3))), Boundary.cuboid([1.0] * 3)).compute()
    i, j = Integral(m), Integral(m)
    i.integrate("monte_carlo", 1000), j.integrate()
    a, b = i.cells.toPandas().sort_values("cell"), j.cells.toPandas().sort_values("cell")
    assert a.volume.sum() == pytest.approx(1, abs=0.1) and np.allclose(a.volume, b.volume, rtol=0.25)
    assert (i.interfaces.toPandas().area >= 0).all()
    h = Integral(m, lambda x: F.array(F.lit(1.0)), integrate.Options())
    h.integrate("heuristic_mc", 500)
    t = h.cells.toPandas()
    assert sum(x[0] for x in t.bulk) == pytest.approx(t.volume.sum(), rel=0.1)


def test_integral_of_itself_raises(spark):
    i = Integral(VoronoiMesh.from_df(points(spark, [(0, 0), (1, 0), (0, 1)])))
    i.running = True
    with pytest.raises(RuntimeError):
        i.integrate()


def test_views_and_numbering(spark):
    df = points(spark, grid(2, 0, 1, 2)).withColumn("id", 3 * F.col("id") + 5)
    assert [tuple(r) for r in mesh.public_ids(df).orderBy("id").collect()] == [(5, 0), (8, 1), (11, 2), (14, 3)]
    to = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "id long, to long")
    assert {tuple(r) for r in mesh.composed(to, to).collect()} == {(0, 2), (1, 0), (2, 1)}
    assert {tuple(r) for r in mesh.composed(to, mesh.inverted(to)).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert {tuple(r) for r in mesh.swapped(to, 0, 1).collect()} == {(1, 1), (0, 2), (2, 0)}
    assert {r["id"] for r in tables.composite(df, df).collect()} == {5, 8, 11, 14, 20, 23, 26, 29}
    moved = tables.set_points(df, spark.createDataFrame([(5, [9.0, 9.0])], "id long, coords array<double>"))
    assert moved.filter("id = 5").first()["coords"] == [9.0, 9.0] and moved.count() == 4


def test_text_files(spark, tmp_path):
    df = points(spark, spread(30, 2, 0, 1, 0.01))
    tables.write_points_csv(df, str(tmp_path / "p"), 2)
    back = tables.read_points_csv(spark, str(tmp_path / "p"), 2)
    assert sorted(r["id"] for r in back.collect()) == list(range(30))
    assert sorted(tuple(r["coords"]) for r in back.collect()) == sorted(tuple(r["coords"]) for r in df.collect())


def test_stored_and_engine_vertices(spark):
    engine = tables.cuboid_vertices(spark, [0] * 3, [1] * 3, [4, 4, 4])
    assert engine.count() == 27
    out = tables.without_erased(engine, engine.limit(2), engine.filter("sigma[0] = 0"))
    assert out.count() in (26, 27)
    assert mesh.contains_vertex(engine, engine.limit(3).withColumn("sigma", F.reverse("sigma"))).count() == 3
    old = spark.createDataFrame([(0, 1, 0, 2.5)], "cell long, neighbour long, occurrence int, area double")
    now = spark.createDataFrame([(0, 1, 0), (0, 2, 0)], "cell long, neighbour long, occurrence int")
    assert {(r["neighbour"], r["area"]) for r in integrate.retargeted(old, now).collect()} == {(1, 2.5), (2, None)}
    r = spark.createDataFrame([(0, 1, [1], 2.0), (1, 0, [-1], 3.0)], "cell long, neighbour long, shift array<int>, area double")
    assert {(x["area"], x["other_area"]) for x in mesh.reciprocal(r).collect()} == {(2.0, 3.0), (3.0, 2.0)}


def test_a_stale_source_is_an_error(spark):
    df = points(spark, spread(20, 2, 0.05, 0.95, 0.05))
    m = VoronoiMesh.from_df(df.filter("id < 15"), Boundary.cuboid([1.0, 1.0])).compute()
    geometry = Integral(m)
    geometry.integrate()
    h = Integral(m, lambda x: F.array(1 + 2 * x[0]), integrate.Options(), source=geometry)
    assert h.integrate("heuristic") == 15 and h.integrate("heuristic") == 0
    exact = Integral(m, lambda x: 1 + 2 * x[:, :1], integrate.Options())
    exact.integrate("heuristic")
    a, b = (sorted((r["cell"], r["bulk"][0]) for r in i.cells.collect()) for i in (h, exact))
    assert np.allclose(a, b)
    m.refine(df.filter("id >= 15"))
    with pytest.raises(RuntimeError, match="out of date"):
        h.integrate("heuristic")
    assert h.integrate("heuristic", force_source_update=True) == 20


def test_wrong_cells_are_found(spark):
    m = VoronoiMesh.from_df(points(spark, spread(15, 2, 0.05, 0.95, 0.05)), Boundary.cuboid([1.0, 1.0])).compute()
    one = m.vertices.limit(1).persist()
    moved = m.vertices.join(one.select("sigma"), "sigma", "left_anti").unionByName(one.withColumn("position", F.transform("position", lambda x: x + 0.01)))
    assert not validate.wrong_cells(m.nodes, moved, m.infinite_edges, 2, m.nodes, m.boundary, max_variance=1e-16).isEmpty()
    fewer = m.vertices.join(one.select("sigma"), "sigma", "left_anti")
    assert not validate.open_edges(fewer, m.infinite_edges, 2).isEmpty()
    assert validate.flat_vertices(m.nodes, m.vertices, m.boundary).isEmpty()
