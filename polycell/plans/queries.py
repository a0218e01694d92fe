"""Registered queries of the geometry operators and their SQL.

Generators are the suppliers (account balance and a golden-ratio sequence of keys,
in the unit square), queries the customers in the same way; embeddings give points
in more dimensions. All queries run over whole tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Integral, VoronoiMesh
from ..functions import vec
from ..operators import construct, integrate, mesh, search, validate
from ..operators.periodic import PeriodicMesh, find_reference, images, requests
from ..operators.spherical import SphericalMesh
from ..sources import tables
from . import boundary as bd
from .boundary import Boundary

GOLDEN = 0.6180339887498949
BOX = Boundary.cuboid([1.0, 1.0])


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _xy(balance: str, key: str):
    return [(F.col(balance) + 1000) / 11000, F.pmod(F.col(key) * F.lit(GOLDEN), F.lit(1.0))]


def sites(spark: SparkSession, d: str) -> DataFrame:
    return tables.nodes(_read(spark, d, "supplier"), "s_suppkey", _xy("s_acctbal", "s_suppkey"))


def asks(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("qid"), vec.point(*_xy("c_acctbal", "c_custkey")).alias("point"))


def vectors(spark: SparkSession, d: str, dim: int) -> DataFrame:
    return tables.nodes(_read(spark, d, "embeddings"), "vec_id", "embedding", dim)


def _xs(column: str, n: int, digits: int = 6):
    return [F.round(F.col(column)[k], digits).alias(f"x{k}") for k in range(n)]


def _name():
    return F.concat_ws(",", F.col("sigma").cast("array<string>")).alias("sigma")


_G = f"""g AS (SELECT CAST(s_suppkey AS BIGINT) AS id, (s_acctbal + 1000) / 11000 AS x, (s_suppkey * {GOLDEN}::DOUBLE) % 1 AS y FROM supplier)"""
_Q = f"""q AS (SELECT CAST(c_custkey AS BIGINT) AS qid, (c_acctbal + 1000) / 11000 AS x, (c_custkey * {GOLDEN}::DOUBLE) % 1 AS y FROM customer)"""
_P = "p AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), (1, -1.0, 0.0, 0.0), (2, 0.0, 1.0, 1.0), (3, 0.0, -1.0, 0.0)) t(plane, nx, ny, c))"
_PAIRS = "d AS (SELECT qid, id, (q.x - g.x) ** 2 + (q.y - g.y) ** 2 AS d2 FROM q, g)"
# Vertices of bounded cells: pairs of half-spaces of a cell whose corner no other half-space cuts off.
_CORNERS = """k AS MATERIALIZED (
  SELECT s.cell, s.name AS n1, t.name AS n2, (s.c * t.ay - t.c * s.ay) / (s.ax * t.ay - s.ay * t.ax) AS px, (s.ax * t.c - t.ax * s.c) / (s.ax * t.ay - s.ay * t.ax) AS py
  FROM h s JOIN h t ON s.cell = t.cell AND s.name < t.name WHERE abs(s.ax * t.ay - s.ay * t.ax) > 1e-12
), good AS (
  SELECT k.cell, n1, n2, any_value(px) AS px, any_value(py) AS py FROM k JOIN h ON h.cell = k.cell GROUP BY k.cell, n1, n2 HAVING max(ax * px + ay * py - c) <= 1e-9
), inc AS MATERIALIZED (
  SELECT cell, n1, n2, px, py, list_sort([cell, n1, n2]) AS sigma FROM good
)"""
_V = f"""h AS MATERIALIZED (
  SELECT a.id AS cell, b.id AS name, b.x - a.x AS ax, b.y - a.y AS ay, (b.x * b.x + b.y * b.y - a.x * a.x - a.y * a.y) / 2 AS c FROM g a JOIN g b ON a.id <> b.id
  UNION ALL SELECT g.id, -1 - plane, nx, ny, c FROM g, p
), {_CORNERS}, v AS (
  SELECT sigma, px, py FROM inc WHERE cell = list_min(list_filter(sigma, lambda s: s >= 0))
)"""
_NB = "nb AS (SELECT DISTINCT cell, n1 AS neighbour FROM inc UNION SELECT DISTINCT cell, n2 FROM inc)"
_FACET = """f AS (
  SELECT a.cell, nbr AS neighbour, max(sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2)) AS area
  FROM (SELECT cell, px, py, unnest([n1, n2]) AS nbr FROM inc) a JOIN (SELECT cell, px, py, unnest([n1, n2]) AS nbr2 FROM inc) b ON a.cell = b.cell AND nbr = nbr2 GROUP BY a.cell, nbr
), fh AS (
  SELECT f.*, c / sqrt(ax * ax + ay * ay) - (ax * g.x + ay * g.y) / sqrt(ax * ax + ay * ay) AS height FROM f JOIN h ON h.cell = f.cell AND h.name = neighbour JOIN g ON g.id = f.cell
)"""

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


# -- sources and planes --------------------------------------------------------------------------


@query(f"WITH {_G} SELECT id, round(x, 6) AS x0, round(y, 6) AS x1 FROM g")
def source_nodes(spark, d):
    return sites(spark, d).select("id", *_xs("coords", 2))


@query(f"""WITH {_G}, m AS (SELECT max(id) + 1 AS n FROM g), {_Q}
SELECT id, round(x, 6) AS x0, round(y, 6) AS x1 FROM g UNION ALL SELECT qid + n, round(x, 6), round(y, 6) FROM q, m""")
def source_composite(spark, d):
    return tables.composite(sites(spark, d), tables.nodes(_read(spark, d, "customer"), "c_custkey", _xy("c_acctbal", "c_custkey"))).select("id", *_xs("coords", 2))


@query(f"WITH {_G}, {_P} SELECT id AS cell, plane, round(x - 2 * (nx * x + ny * y - c) * nx, 6) AS x0, round(y - 2 * (nx * x + ny * y - c) * ny, 6) AS x1 FROM g, p")
def source_mirrors(spark, d):
    return bd.mirror_rows(sites(spark, d), BOX).select("cell", "plane", *_xs("coords", 2))


@query("SELECT i AS id, round(-1 + 0.5 * (i // 9), 6) AS x0, round(-1 + 0.5 * ((i // 3) % 3), 6) AS x1, round(-1 + 0.5 * (i % 3), 6) AS x2 FROM range(27) t(i)")
def source_cuboid_nodes(spark, d):
    return construct.engine(spark, "cuboid", start="-1,-1,-1", spacing="0.5,0.5,0.5", counts="3,3,3").select("id", *_xs("coords", 3))


@query("""WITH c AS (SELECT (i // 9) * 16 + ((i // 3) % 3) * 4 + i % 3 AS b, i FROM range(27) t(i))
SELECT array_to_string(list_sort([b, b + 1, b + 4, b + 5, b + 16, b + 17, b + 20, b + 21]), ',') AS sigma, round(0.5 + i // 9, 6) AS x0, round(0.5 + (i // 3) % 3, 6) AS x1, round(0.5 + i % 3, 6) AS x2 FROM c""")
def source_cuboid_vertices(spark, d):
    return tables.cuboid_vertices(spark, [0, 0, 0], [1, 1, 1], [4, 4, 4]).select(_name(), *_xs("position", 3))


@query("""WITH c AS (SELECT i, i // 9 AS a, (i // 3) % 3 AS b, i % 3 AS c FROM range(27) t(i))
SELECT x.i AS cell, y.i AS neighbour, 0 AS occurrence FROM c x JOIN c y ON abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) = 1""")
def source_cuboid_neighbours(spark, d):
    return tables.cuboid_neighbours(spark, [3, 3, 3])


@query("""WITH c AS (SELECT i, i // 25 AS a, (i // 5) % 5 AS b, i % 5 AS c FROM range(125) t(i))
SELECT i AS cell, CASE WHEN least(a, b, c) = 0 OR greatest(a, b, c) = 4 THEN 'inf' ELSE '3.0' END AS volume FROM c""")
def source_cuboid_cells(spark, d):
    m = tables.CuboidMesh(spark, [0.0] * 3, [1.0, 1.5, 2.0], [5, 5, 5])
    return m.cells.select("cell", F.when(F.col("volume") == float("inf"), "inf").otherwise(F.col("volume").cast("string")).alias("volume"))


@query("""WITH c AS (SELECT i, i // 5 AS a, i % 5 AS b FROM range(25) t(i))
SELECT x.i AS cell, y.i AS neighbour, CASE WHEN x.a = y.a THEN CASE WHEN x.a IN (0, 4) THEN 'inf' ELSE '1.0' END ELSE CASE WHEN x.b IN (0, 4) THEN 'inf' ELSE '2.0' END END AS area FROM c x JOIN c y ON abs(x.a - y.a) + abs(x.b - y.b) = 1""")
def source_cuboid_interfaces(spark, d):
    m = tables.CuboidMesh(spark, [0.0] * 2, [1.0, 2.0], [5, 5])
    return m.interfaces.select("cell", "neighbour", F.when(F.col("area") == float("inf"), "inf").otherwise(F.col("area").cast("string")).alias("area"))


@query(f"WITH {_Q}, {_P} SELECT qid, plane, round(nx * 2 * (x - 0.5) + ny * 2 * (y - 0.5) - c, 6) AS value FROM q, p")
def plane_values(spark, d):
    q = asks(spark, d).withColumn("point", F.transform("point", lambda x: 2 * (x - 0.5)))
    return q.select("qid", F.posexplode(F.array(*BOX.values("point"))).alias("plane", "value")).select("qid", "plane", F.round("value", 6).alias("value"))


@query(f"WITH {_Q} SELECT qid FROM q WHERE 2 * x - 0.5 <= 1 AND 2 * x - 0.5 >= 0 AND 2 * y - 0.5 <= 1 AND 2 * y - 0.5 >= 0")
def boundary_contains(spark, d):
    q = asks(spark, d).withColumn("point", F.transform("point", lambda x: 2 * x - 0.5))
    return q.filter(BOX.contains("point")).select("qid")


@query(f"WITH {_Q}, {_P} SELECT qid, plane, round(x - (nx * x + ny * y - c) * nx, 6) AS x0, round(y - (nx * x + ny * y - c) * ny, 6) AS x1 FROM q, p")
def plane_project(spark, d):
    rows = F.array(*[F.struct(F.lit(i).alias("plane"), BOX.project("point", i).alias("p")) for i in range(4)])
    return asks(spark, d).select("qid", F.explode(rows).alias("r")).select("qid", "r.plane", *_xs("r.p", 2))


@query(f"WITH {_Q} SELECT qid, round(least(greatest(3 * x - 1, 0), 1), 6) AS x0, round(least(greatest(3 * y - 1, 0), 1), 6) AS x1 FROM q")
def boundary_project_inside(spark, d):
    q = asks(spark, d).withColumn("point", F.transform("point", lambda x: 3 * x - 1))
    return q.withColumn("point", BOX.project_inside("point")).select("qid", *_xs("point", 2))


@query(f"""WITH {_Q}, {_P}, r AS (
  SELECT qid, plane, (c - nx * x - ny * y) / (nx * (0.3 - y) + ny * (x - 0.7)) AS t FROM q, p WHERE abs(nx * (0.3 - y) + ny * (x - 0.7)) > 1e-14
), b AS (SELECT qid, t, plane, row_number() OVER (PARTITION BY qid ORDER BY t, plane) AS k FROM r WHERE t > 0)
SELECT qid, round(t, 4) AS t, plane FROM b WHERE k = 1""")
def boundary_first_intersection(spark, d):
    u = F.array(F.lit(0.3) - F.col("point")[1], F.col("point")[0] - F.lit(0.7))
    return asks(spark, d).withColumn("h", BOX.first_intersection("point", u)).filter("h is not null").select("qid", F.round("h.t", 4).alias("t"), "h.plane")


@query("SELECT * FROM (VALUES ('dirichlet', 2), ('periodic', 4)) t(cond, planes)")
def boundary_split(spark, d):
    b = Boundary.cuboid([1.0, 2.0, 3.0], periodic={0, 1})
    return b.frame(spark).groupBy("cond").agg(F.count(F.lit(1)).cast("int").alias("planes"))


@query("SELECT * FROM (VALUES (0, 1, -1.0::DOUBLE, 0.0::DOUBLE), (2, 3, 0.0, -2.0)) t(plane, partner, s0, s1)")
def boundary_periodic_shift(spark, d):
    p = Boundary.cuboid([1.0, 2.0], periodic=None).frame(spark)
    o = p.select(F.col("plane").alias("partner"), F.col("base").alias("other"))
    s = vec.sub("other", "base")
    return p.join(o, "partner").filter("plane < partner").select("plane", "partner", s[0].alias("s0"), s[1].alias("s1"))


@query(f"""WITH {_G}, {_P}, a AS (SELECT x, y FROM g UNION ALL SELECT x - 2 * (nx * x + ny * y - c) * nx, y - 2 * (nx * x + ny * y - c) * ny FROM g, p)
SELECT 0 AS axis, round(min(x), 6) AS low, round(max(x), 6) AS high FROM a UNION ALL SELECT 1, round(min(y), 6), round(max(y), 6) FROM a""")
def boundary_bounding_box(spark, d):
    return bd.bounding_box(sites(spark, d), BOX).select("axis", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {_Q} SELECT qid, round(((x * 5 + 0.25) % 1 + 1) % 1, 6) AS x0, round(y * 5, 6) AS x1 FROM q")
def wrap_points(spark, d):
    q = asks(spark, d).withColumn("p", F.transform("point", lambda x: x * 5))
    q = q.withColumn("p", F.array(F.col("p")[0] + 0.25, F.col("p")[1]))
    return q.withColumn("p", vec.wrapped("p", vec.literal([0, 0]), F.array(F.lit(1.0), F.lit(None).cast("double")))).select("qid", *_xs("p", 2))


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:3] AS e FROM embeddings), n AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM e),
c AS (SELECT id, CASE WHEN list_filter(u, lambda x: x <> 0)[1] < 0 THEN list_transform(u, lambda x: -x) ELSE u END AS u FROM n)
SELECT id, round(u[1], 6) AS x0, round(u[2], 6) AS x1, round(u[3], 6) AS x2 FROM c""")
def canonical_points(spark, d):
    n = vectors(spark, d, 3)
    return n.withColumn("u", vec.canonical_hemisphere(vec.normalized("coords"))).select("id", *_xs("u", 3))


# -- search --------------------------------------------------------------------------------------


@query(f"WITH {_G}, {_Q}, {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS k FROM d) SELECT qid, id, round(d2, 9) AS d2 FROM r WHERE k = 1")
def search_nn(spark, d):
    return search.nn(asks(spark, d), sites(spark, d)).select("qid", "id", F.round("d2", 9).alias("d2"))


@query(f"WITH {_G}, {_Q}, {_PAIRS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS INTEGER) AS rank FROM d) SELECT qid, rank, id FROM r WHERE rank <= 5")
def search_knn(spark, d):
    return search.knn(asks(spark, d), sites(spark, d), 5).select("qid", "rank", "id")


@query(SQL["search_knn"])
def search_knn_grid(spark, d):
    return search.knn(asks(spark, d), sites(spark, d), 5, "grid").select("qid", "rank", "id")


@query(f"WITH {_G}, {_Q}, {_PAIRS} SELECT qid, id FROM d WHERE d2 < 0.1::DOUBLE * 0.1::DOUBLE")
def search_inrange(spark, d):
    return search.inrange(asks(spark, d), sites(spark, d), 0.1).select("qid", "id")


@query(SQL["search_inrange"])
def search_inrange_grid(spark, d):
    return search.inrange(asks(spark, d), sites(spark, d), 0.1, "grid").select("qid", "id")


@query(f"WITH {_G}, {_Q}, {_PAIRS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS INTEGER) AS rank FROM d WHERE id <> qid) SELECT qid, rank, id FROM r WHERE rank <= 3")
def search_skip(spark, d):
    return search.knn(asks(spark, d).withColumn("skip", F.array("qid")), sites(spark, d), 3).select("qid", "rank", "id")


@query(SQL["search_knn"])
def search_composite(spark, d):
    n, q = sites(spark, d), asks(spark, d)
    parts = [search.knn(q, n.filter(c), 5) for c in ("id % 2 = 0", "id % 2 = 1")]
    return search.merged_knn(5, *parts).select("qid", "rank", "id")


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.id AS qid, b.id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) ** 2)), b.id) AS INTEGER) AS rank FROM e a JOIN e b ON a.id <> b.id)
SELECT qid, rank, id FROM d WHERE rank <= 3""")
def search_knn_64d(spark, d):
    n = vectors(spark, d, 64)
    q = n.select(F.col("id").alias("qid"), F.col("coords").alias("point"), F.array("id").alias("skip"))
    return search.knn(q, n, 3).select("qid", "rank", "id")


@query(f"""WITH {_G}, r AS (
  SELECT a.id AS rid, b.id AS generator, ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / (2 * (0.6::DOUBLE * (b.x - a.x) + 0.8::DOUBLE * (b.y - a.y))) AS t
  FROM g a JOIN g b ON a.id <> b.id WHERE 0.6::DOUBLE * (b.x - a.x) + 0.8::DOUBLE * (b.y - a.y) > 1e-14
), k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY t, generator) AS k FROM r)
SELECT g.id AS rid, round(t, 6) AS t, generator FROM g LEFT JOIN k ON rid = id AND k = 1""")
def ray_cast_first(spark, d):
    n = sites(spark, d)
    rays = n.select(F.col("id").alias("rid"), F.col("id").alias("start"), F.col("coords").alias("origin"), vec.literal([0.6, 0.8]).alias("direction"))
    return search.first_hit(rays, n).select("rid", F.round("t", 6).alias("t"), "generator")


@query("""WITH g AS (SELECT i AS id, i // 6 AS x, i % 6 AS y FROM range(36) t(i)), r AS (
  SELECT a.id AS rid, b.id AS generator, ((b.x - a.x) ** 2 + (b.y - a.y) ** 2) / (2 * sqrt(0.5::DOUBLE) * (b.x - a.x + b.y - a.y)) AS t
  FROM g a JOIN g b ON a.id <> b.id WHERE b.x - a.x + b.y - a.y > 0
), k AS (SELECT rid, min(t) AS t FROM r GROUP BY rid), s AS (SELECT r.rid, k.t, list(generator) AS l FROM r JOIN k ON r.rid = k.rid AND r.t <= k.t + 1e-9 GROUP BY r.rid, k.t)
SELECT g.id AS rid, round(t, 6) AS t, CASE WHEN t IS NULL THEN '' ELSE array_to_string(list_sort(list_append(l, g.id)), ',') END AS sigma FROM g LEFT JOIN s ON rid = id""")
def ray_cast_ties(spark, d):
    """Rays along the diagonals of a grid, which meet three generators at once."""
    n = tables.cuboid_nodes(spark, [0, 0], [1, 1], [6, 6])
    u = vec.literal([0.5**0.5, 0.5**0.5])
    rays = n.select(F.col("id").alias("rid"), F.col("id").alias("start"), F.col("coords").alias("origin"), u.alias("direction"), F.array().cast("array<bigint>").alias("skip"))
    return search.ray_cast(rays, n).select("rid", F.round("t", 6).alias("t"), _name())


# -- construction and relations ------------------------------------------------------------------


def _bounded(spark, d) -> VoronoiMesh:
    return VoronoiMesh.from_df(sites(spark, d), BOX).compute()


_SEE = "SELECT array_to_string(sigma, ',') AS sigma, round(px, 6) AS x0, round(py, 6) AS x1 FROM v"


@query(f"WITH {_G}, {_P}, {_V} {_SEE}")
def voronoi_vertices(spark, d):
    return _bounded(spark, d).vertices.select(_name(), *_xs("position", 2))


@query(SQL["voronoi_vertices"])
def voronoi_vertices_bins(spark, d):
    """The same by bins and certified cells, as for generators beyond a broadcast."""
    return construct.vertices(construct.cell_rows(sites(spark, d), BOX, strategy="bins")).select(_name(), *_xs("position", 2))


@query(f"""WITH {_G}, e AS (
  SELECT a.id AS i, b.id AS j, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM g a JOIN g b ON a.id < b.id
), s AS (SELECT i, j, max(dx * (y - ay) - dy * (x - ax)) AS hi, min(dx * (y - ay) - dy * (x - ax)) AS lo FROM e JOIN g ON id <> i AND id <> j GROUP BY i, j)
SELECT i || ',' || j AS sigma FROM s WHERE hi < 0 OR lo > 0""")
def voronoi_infinite_edges(spark, d):
    return VoronoiMesh.from_df(sites(spark, d)).infinite_edges.select(_name())


@query(f"WITH {_G}, {_P}, {_V} SELECT DISTINCT cell, s AS adjacent FROM (SELECT cell, unnest([n1, n2]) AS s FROM inc) WHERE s >= 0")
def mesh_adjacency(spark, d):
    return _bounded(spark, d).adjacency()


@query(f"WITH {_G}, {_P}, {_V}, {_NB} SELECT cell, neighbour FROM nb")
def mesh_neighbours(spark, d):
    return _bounded(spark, d).neighbours()


@query(f"WITH {_G}, {_P}, {_V} SELECT cell, array_to_string(sigma, ',') AS sigma, cell = list_min(list_filter(sigma, lambda s: s >= 0)) AS owner FROM inc")
def mesh_incidence(spark, d):
    return mesh.incidence(_bounded(spark, d).vertices).select("cell", _name(), "owner")


@query(f"WITH {_G}, {_P}, {_V} {_SEE} WHERE px < 0.5 AND len(list_filter(sigma, lambda s: s % 7 = 0 AND s >= 0)) = 0")
def mesh_filter(spark, d):
    m = _bounded(spark, d)
    _, v, _ = mesh.filtered(m.nodes, m.vertices, m.infinite_edges, F.col("id") % 7 != 0, F.col("position")[0] < 0.5)
    return v.select(_name(), *_xs("position", 2))


@query(f"WITH {_G}, n AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS public_id FROM g) SELECT public_id FROM n WHERE id % 7 = 0")
def mesh_erase_nodes(spark, d):
    m = _bounded(spark, d)
    return mesh.erase_nodes_if(m.nodes, m.vertices, m.infinite_edges, F.col("id") % 7 == 0)[3]


@query(f"WITH {_G} SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS public_id FROM g")
def mesh_public_ids(spark, d):
    return mesh.public_ids(sites(spark, d))


@query(f"WITH {_G} SELECT id, CAST(row_number() OVER (ORDER BY id % 3 <> 0, id) - 1 AS BIGINT) AS place FROM g")
def mesh_visible_first(spark, d):
    n = sites(spark, d).withColumn("kind", F.when(F.col("id") % 3 == 0, "visible").otherwise("reference"))
    return mesh.visible_first(n)


@query(f"WITH {_G}, {_P}, {_V} SELECT array_to_string(list_sort(list_transform(sigma, lambda s: CASE WHEN s >= 0 THEN 10 * s + 3 ELSE s END)), ',') AS sigma, round(px, 6) AS x0, round(py, 6) AS x1 FROM v")
def mesh_renumbered(spark, d):
    m = _bounded(spark, d)
    to = m.nodes.select("id", (10 * F.col("id") + 3).alias("to"))
    return mesh.renumbered(m.vertices, to).select(_name(), *_xs("position", 2))


@query(SQL["voronoi_vertices"])
def voronoi_refine(spark, d):
    n = sites(spark, d)
    m = VoronoiMesh.from_df(n.filter("id % 5 <> 0"), BOX).compute()
    m.refine(n.filter("id % 5 = 0"))
    return m.vertices.select(_name(), *_xs("position", 2))


@query(f"WITH {_G.replace('FROM supplier', 'FROM supplier WHERE s_suppkey % 5 <> 0')}, {_P}, {_V} {_SEE}")
def voronoi_remove(spark, d):
    n = sites(spark, d)
    m = VoronoiMesh.from_df(n, BOX).compute()
    m.remove(n.filter("id % 5 = 0"))
    return m.vertices.select(_name(), *_xs("position", 2))


# -- integration ---------------------------------------------------------------------------------


def _integral(spark, d, method: str, f=None) -> Integral:
    i = Integral(_bounded(spark, d), f, integrate.Options())
    i.integrate(method)
    return i


_VOL = f"WITH {_G}, {_P}, {_V}, {_FACET} SELECT cell, round(sum(area * height / 2), 6) AS volume FROM fh GROUP BY cell"


@query(_VOL)
def cell_volumes(spark, d):
    return _integral(spark, d, "fast_polygon").cells.select("cell", F.round("volume", 6).alias("volume"))


@query(_VOL)
def cell_volumes_determinants(spark, d):
    return _integral(spark, d, "polygon").cells.select("cell", F.round("volume", 6).alias("volume"))


@query(f"WITH {_G}, {_P}, {_V}, {_FACET} SELECT cell, neighbour, round(area, 6) AS area FROM fh")
def interface_areas(spark, d):
    return _integral(spark, d, "fast_polygon").interfaces.select("cell", "neighbour", F.round("area", 6).alias("area"))


def _affine(x):
    return (1 + 2 * x[:, :1] + 3 * x[:, 1:2]).copy()


# An affine integrand's facet integral is area times its value in the middle, and the rule for the bulk is
# height / 2 * (area f(x) / 3 + 2 / 3 of the facet's integral).
@query(f"""WITH {_G}, {_P}, {_V}, {_FACET}, m AS (SELECT cell, nbr AS neighbour, avg(px) AS mx, avg(py) AS my FROM (SELECT cell, px, py, unnest([n1, n2]) AS nbr FROM inc) GROUP BY cell, nbr)
SELECT fh.cell, round(sum(height / 2 * area * ((1 + 2 * x + 3 * y) / 3 + 2 * (1 + 2 * mx + 3 * my) / 3)), 6) AS bulk FROM fh JOIN m ON m.cell = fh.cell AND m.neighbour = fh.neighbour JOIN g ON g.id = fh.cell GROUP BY fh.cell""")
def cell_integrals(spark, d):
    return _integral(spark, d, "fast_polygon", _affine).cells.select("cell", F.round(F.col("bulk")[0], 6).alias("bulk"))


@query(SQL["cell_integrals"])
def cell_integrals_heuristic(spark, d):
    """Exact for affine integrands, as the heuristic's rule is the same there."""
    return _integral(spark, d, "heuristic", _affine).cells.select("cell", F.round(F.col("bulk")[0], 6).alias("bulk"))


def _roots(d: int) -> list[float]:
    pairs, root = (d + 1) // 2, 2.0
    for _ in range(40):
        root = (1 + root) ** (1 / (2 * pairs + 1))
    return [root ** -(k + 1) for k in range(2 * pairs)]


_R = _roots(2)
_MC = f"""{_G}, {_P}, n AS (SELECT i, (0.5 + (i + 1) * {_R[1]!r}::DOUBLE) % 1 AS a FROM range(1000) t(i)), u AS (SELECT i, cos({2 * math.pi!r}::DOUBLE * a) AS ux, sin({2 * math.pi!r}::DOUBLE * a) AS uy FROM n), h AS (
  SELECT a.id AS cell, b.id AS name, b.x - a.x AS ax, b.y - a.y AS ay, ((b.x - a.x) ** 2 + (b.y - a.y) ** 2) / 2 AS c FROM g a JOIN g b ON a.id <> b.id
  UNION ALL SELECT g.id, -1 - plane, nx, ny, c - nx * x - ny * y FROM g, p
), t AS (SELECT cell, i, name, c / (ax * ux + ay * uy) AS t, (ax * ux + ay * uy) / sqrt(ax * ax + ay * ay) AS slope FROM h, u WHERE ax * ux + ay * uy > 1e-14),
b AS (SELECT cell, i, min(t) AS t, arg_min(name, t) AS name, arg_min(slope, t) AS slope FROM t GROUP BY cell, i)"""


def _mc(spark, d, f=None):
    m = _bounded(spark, d)
    return m, *integrate.monte_carlo(m.nodes, m.neighbours(), BOX, 2, f=f)


@query(f"WITH {_MC} SELECT cell, round(sum(t * t) * {math.pi!r}::DOUBLE / 1000, 6) AS volume FROM b GROUP BY cell")
def monte_carlo_volumes(spark, d):
    return _mc(spark, d)[1].select("cell", F.round("volume", 6).alias("volume"))


@query(f"WITH {_MC} SELECT cell, name AS neighbour, round(sum(t / slope) * 2 * {math.pi!r}::DOUBLE / 1000, 6) AS area FROM b GROUP BY cell, name")
def monte_carlo_areas(spark, d):
    return _mc(spark, d)[2].select("cell", "neighbour", F.round("area", 6).alias("area"))


# Sums over the radii i of a ray: of r, and of r^2, as the integrand is affine.
@query(f"""WITH {_MC}, r AS (SELECT sum((i + 0.5) / 100) AS r1, sum(((i + 0.5) / 100) ** 2) AS r2 FROM range(100) t(i)), w AS (SELECT b.cell, b.i, t, t * t * {2 * math.pi!r}::DOUBLE / 1000 / 100 AS w FROM b)
SELECT w.cell, round(sum(w * r1), 4) AS one, round(sum(w * ((1 + 2 * x + 3 * y) * r1 + t * (2 * ux + 3 * uy) * r2)), 4) AS affine FROM w JOIN u ON u.i = w.i JOIN g ON g.id = w.cell, r GROUP BY w.cell""")
def monte_carlo_integrals(spark, d):
    m, cells, _ = _mc(spark, d, lambda x: F.array(F.lit(1.0), 1 + 2 * x[0] + 3 * x[1]))
    return cells.select("cell", F.round(F.col("bulk")[0], 4).alias("one"), F.round(F.col("bulk")[1], 4).alias("affine"))


@query(f"""WITH {_MC}, s AS (SELECT cell, name AS neighbour, sum(t / slope) * 2 * {math.pi!r}::DOUBLE / 1000 AS area FROM b GROUP BY cell, name)
SELECT a.cell, a.neighbour, round(CASE WHEN o.area IS NULL OR least(a.area, o.area) < 1e-10 * greatest(a.area, o.area) THEN a.area ELSE (a.area + o.area) / 2 END, 6) AS area
FROM s a LEFT JOIN s o ON o.cell = a.neighbour AND o.neighbour = a.cell""")
def monte_carlo_symmetrised(spark, d):
    m, cells, interfaces = _mc(spark, d)
    return integrate.symmetrised(m.nodes, cells, interfaces, 2)[1].select("cell", "neighbour", F.round("area", 6).alias("area"))


@query(f"""WITH {_MC.replace("h AS (", "hr AS (", 1).replace("FROM h, u", "FROM hr, u")}, {_V.replace("), k AS", "), k AS", 1)},
s AS (SELECT cell, name AS neighbour, sum(t / slope) * 2 * {math.pi!r}::DOUBLE / 1000 AS area FROM b GROUP BY cell, name),
y AS (SELECT a.cell, a.neighbour, a.area AS old, CASE WHEN o.area IS NULL OR least(a.area, o.area) < 1e-10 * greatest(a.area, o.area) THEN a.area ELSE (a.area + o.area) / 2 END AS area FROM s a LEFT JOIN s o ON o.cell = a.neighbour AND o.neighbour = a.cell),
z AS (SELECT y.*, CASE WHEN neighbour >= 0 THEN sqrt((q.x - g.x) ** 2 + (q.y - g.y) ** 2) / 2 ELSE (SELECT c - nx * g.x - ny * g.y FROM p WHERE plane = -1 - neighbour) END AS height, g.x, g.y FROM y JOIN g ON g.id = cell LEFT JOIN g q ON q.id = neighbour),
vol AS (SELECT cell, sum(t * t) * {math.pi!r}::DOUBLE / 1000 AS v FROM b GROUP BY cell), more AS (SELECT cell, sum(CASE WHEN neighbour >= 0 THEN (area - old) * height / 2 ELSE 0 END) AS dv FROM z GROUP BY cell),
mid AS (SELECT cell, nbr AS neighbour, avg(px) AS mx, avg(py) AS my FROM (SELECT cell, px, py, unnest([n1, n2]) AS nbr FROM inc) GROUP BY cell, nbr),
bulk AS (SELECT z.cell, sum(height / 2 * area * ((1 + 2 * x + 3 * y) / 3 + 2 * (1 + 2 * mx + 3 * my) / 3)) AS bulk FROM z JOIN mid ON mid.cell = z.cell AND mid.neighbour = z.neighbour GROUP BY z.cell)
SELECT vol.cell, round(v + dv, 6) AS volume, round(bulk, 6) AS bulk FROM vol JOIN more ON more.cell = vol.cell JOIN bulk ON bulk.cell = vol.cell""")
def heuristic_monte_carlo(spark, d):
    m, cells, interfaces = _mc(spark, d)
    cells, interfaces = integrate.symmetrised(m.nodes, cells, interfaces, 2)
    out, _ = integrate.heuristic_mc(m.nodes, m.vertices, cells, interfaces, 2, lambda x: F.array(1 + 2 * x[0] + 3 * x[1]), BOX)
    return out.select("cell", F.round("volume", 6).alias("volume"), F.round(F.col("bulk")[0], 6).alias("bulk"))


@query(f"""WITH {_G}, e AS (SELECT a.id AS i, b.id AS j, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM g a JOIN g b ON a.id < b.id
), s AS (SELECT i, j, max(dx * (y - ay) - dy * (x - ax)) AS hi, min(dx * (y - ay) - dy * (x - ax)) AS lo FROM e JOIN g ON id <> i AND id <> j GROUP BY i, j)
SELECT DISTINCT unnest([i, j]) AS cell FROM s WHERE hi < 0 OR lo > 0""")
def unbounded_cells(spark, d):
    i = Integral(VoronoiMesh.from_df(sites(spark, d)).compute(), None)
    i.integrate()
    return i.cells.filter(F.col("volume") == float("inf")).select("cell")


# -- validation ----------------------------------------------------------------------------------


# Faults are planted by the smallest generator of a vertex: it is moved where that leaves 0 divided by 10, and goes where it leaves 5.
_FAULTS = "o AS (SELECT sigma, px + CASE WHEN own % 10 = 0 THEN 0.01 ELSE 0 END AS px, py, own FROM (SELECT *, list_min(list_filter(sigma, lambda s: s >= 0)) AS own FROM v) WHERE own % 10 <> 5)"
_WRONG = f"""{_FAULTS}, e AS (SELECT sigma, px, py, own, unnest(sigma) AS s FROM o), m AS (
  SELECT sigma, (px - x) ** 2 + (py - y) ** 2 AS d2 FROM e JOIN g ON id = s
  UNION ALL SELECT sigma, (px - (x - 2 * (nx * x + ny * y - c) * nx)) ** 2 + (py - (y - 2 * (nx * x + ny * y - c) * ny)) ** 2 FROM e JOIN p ON plane = -1 - s JOIN g ON id = own
), r AS (SELECT o.*, sqrt((px - x) ** 2 + (py - y) ** 2) AS r FROM o JOIN g ON id = own), wrong AS (
  SELECT sigma, 'variance' AS reason FROM m GROUP BY sigma HAVING var_pop(d2) / avg(d2) ** 2 > 1e-18
  UNION SELECT sigma, CASE WHEN sqrt((px - x) ** 2 + (py - y) ** 2) < r - 1e-9 THEN 'nearer' ELSE 'missing' END FROM r JOIN g ON NOT list_contains(sigma, id) AND sqrt((px - x) ** 2 + (py - y) ** 2) <= r + 1e-9
), ends AS (
  SELECT edge, count(*) AS ends FROM (SELECT unnest([sigma[1:2], sigma[2:3], [sigma[1], sigma[3]]]) AS edge FROM o) WHERE edge[2] >= 0 GROUP BY edge HAVING count(*) <> 2
)"""


def _faulty(spark, d):
    """(mesh, its vertices with planted faults)."""
    m = _bounded(spark, d)
    v = m.vertices.withColumn("own", F.array_min(F.filter("sigma", lambda s: s >= 0))).filter("own % 10 <> 5")
    moved = F.when(F.col("own") % 10 == 0, F.array(F.col("position")[0] + 0.01, F.col("position")[1])).otherwise(F.col("position"))
    return m, v.select("sigma", moved.alias("position"))


@query(f"WITH {_G}, {_P}, {_V}, {_WRONG} SELECT array_to_string(sigma, ',') AS sigma, reason FROM wrong")
def validate_vertices(spark, d):
    m, v = _faulty(spark, d)
    return validate.wrong_vertices(m.nodes, v, 1e-18, boundary=BOX).select(_name(), "reason")


@query(f"WITH {_G}, {_P}, {_V}, {_WRONG} SELECT DISTINCT cell, what FROM (SELECT unnest(sigma) AS cell, reason AS what FROM wrong UNION ALL SELECT unnest(edge), 'edge' FROM ends) WHERE cell >= 0")
def validate_cells(spark, d):
    m, v = _faulty(spark, d)
    return validate.wrong_cells(m.nodes, v, m.infinite_edges, 2, m.nodes, BOX, max_variance=1e-18)


@query(f"WITH {_G}, {_P}, {_V} SELECT array_to_string(sigma, ',') AS sigma, 1 AS rank FROM v WHERE len(list_filter(sigma, lambda s: s < 0 OR s % 2 <> 0)) = 0")
def validate_ranks(spark, d):
    """Signatures whose generators, once those with even ids are put on one line, don't span the plane."""
    n = sites(spark, d)
    on_line = n.withColumn("coords", F.when(F.col("id") % 2 == 0, F.array(F.col("coords")[0], F.col("coords")[0] / 2)).otherwise(F.col("coords")))
    return validate.flat_vertices(on_line, _bounded(spark, d).vertices, BOX).select(_name(), "rank")


@query(SQL["voronoi_vertices"].replace("round(px, 6) AS x0, round(py, 6) AS x1 FROM v", "round(px, 5) AS x0, round(py, 5) AS x1 FROM v"))
def voronoi_vertices_through_the_facade(spark, d):
    m = VoronoiMesh.from_df(sites(spark, d)).set_boundary(BOX)
    return m.vertices.select(_name(), *_xs("position", 2, 5))


@query(f"WITH {_G}, {_P}, {_V}, {_WRONG} SELECT * FROM (SELECT unnest(edge) AS cell, ends FROM ends) WHERE cell >= 0")
def validate_edges(spark, d):
    m, v = _faulty(spark, d)
    return validate.open_edges(v, m.infinite_edges, 2).select("cell", "ends")


@query(f"WITH {_G}, {_P}, {_V}, o AS (SELECT list_min(list_filter(sigma, lambda s: s >= 0)) AS own FROM v) SELECT count(*) FILTER (own % 10 = 5) AS missing_right, 0 AS missing_left, count(*) FILTER (own % 10 = 0) AS moved FROM o")
def validate_compare(spark, d):
    """Vertices built by bins against those with planted faults."""
    a = construct.vertices(construct.cell_rows(sites(spark, d), BOX, strategy="bins"))
    return validate.compare(a, _faulty(spark, d)[1]).select("missing_right", "missing_left", "moved")


@query("""WITH c AS (SELECT i // 25 AS a, (i // 5) % 5 AS b, i % 5 AS c FROM range(125) t(i)), n AS (SELECT *, (a IN (0, 4))::INT + (b IN (0, 4))::INT + (c IN (0, 4))::INT AS walls FROM c)
SELECT round(-1 + 0.5 * a, 6) AS x0, round(-1 + 0.5 * b, 6) AS x1, round(-1 + 0.5 * c, 6) AS x2, CAST(2 ** (3 - walls) + walls AS INTEGER) AS members FROM n""")
def voronoi_degenerate_grid(spark, d):
    """Vertices where up to eight cells meet."""
    n = tables.cuboid_nodes(spark, [-0.75] * 3, [0.5] * 3, [4, 4, 4])
    return VoronoiMesh.from_df(n, Boundary.centred_cube(3, 1.0)).vertices.select(*_xs("position", 3), F.size("sigma").alias("members"))


# -- periodic, spherical, more dimensions --------------------------------------------------------


# Images are named 3 * id, + 1 one length lower and + 2 one higher; other walls are planes 2 and 3. What is half a length away (more, for few sites) takes no part.
_PERIODIC = f"""im AS (SELECT 3 * id + k AS name, id, x + s AS x, y FROM g, (VALUES (0, 0), (1, -1), (2, 1)) t(k, s)), h AS MATERIALIZED (
  SELECT a.id AS cell, b.name, b.x - a.x AS ax, b.y - a.y AS ay, (b.x * b.x + b.y * b.y - a.x * a.x - a.y * a.y) / 2 AS c FROM g a JOIN im b ON b.name <> 3 * a.id AND abs(b.x - a.x) <= greatest(0.5, 15.0 / (SELECT count(*) FROM g))
  UNION ALL SELECT g.id, -1 - plane, nx, ny, c FROM g, p WHERE plane >= 2
), {_CORNERS}"""
_OWNER = "lambda s: CASE WHEN s >= 0 THEN s // 3 ELSE s END"


def _periodic(spark, d) -> PeriodicMesh:
    return PeriodicMesh(sites(spark, d), Boundary.cuboid([1.0, 1.0], periodic={0})).compute()


@query(f"WITH {_G}, {_P}, {_PERIODIC} SELECT cell, array_to_string(list_sort(list_transform([3 * cell, n1, n2], {_OWNER})), ',') AS sigma, round((px % 1 + 1) % 1, 6) AS x0, round(py, 6) AS x1 FROM inc")
def periodic_vertices(spark, d):
    return _periodic(spark, d).public_vertices().select("cell", _name(), *_xs("position", 2))


@query(f"WITH {_G}, {_P}, {_PERIODIC} SELECT DISTINCT 3 * cell AS node, CASE WHEN n % 3 = 2 THEN 0 ELSE 1 END AS plane FROM (SELECT cell, unnest([n1, n2]) AS n FROM inc) WHERE n >= 0 AND n % 3 > 0")
def periodic_requests(spark, d):
    m = _periodic(spark, d)
    return requests(m.vertices(), m.images, m.boundary)


_PERIODIC_FACES = f"{_PERIODIC}, {_FACET}"


@query(f"WITH {_G}, {_P}, {_PERIODIC_FACES} SELECT cell, round(sum(area * height / 2), 6) AS volume FROM fh GROUP BY cell")
def periodic_volumes(spark, d):
    return _periodic(spark, d).integrate()[0].select("cell", F.round("volume", 6).alias("volume"))


@query(f"""WITH {_G}, {_P}, {_PERIODIC_FACES} SELECT cell, CASE WHEN neighbour >= 0 THEN neighbour // 3 ELSE neighbour END AS neighbour, CASE WHEN neighbour >= 0 THEN [0, -1, 1][neighbour % 3 + 1] END AS step, round(area, 6) AS area,
CASE WHEN neighbour >= 0 THEN round(area, 6) END AS other_area FROM fh""")
def periodic_interfaces(spark, d):
    """Areas, and those that the cell on the other side has."""
    i = _periodic(spark, d).integrate()[1]
    return i.select("cell", "neighbour", F.try_element_at("shift", F.lit(1)).alias("step"), F.round("area", 6).alias("area"), F.round("other_area", 6).alias("other_area"))


@query(f"""WITH {_G}, {_P}, {_PERIODIC_FACES}, m AS (SELECT cell, nbr AS neighbour, avg(cos({2 * math.pi!r}::DOUBLE * px)) AS mv, avg(px) AS mx FROM (SELECT cell, px, py, unnest([n1, n2]) AS nbr FROM inc) GROUP BY cell, nbr)
SELECT fh.cell, round(sum(height / 2 * area * (cos({2 * math.pi!r}::DOUBLE * x) / 3 + 2 * (mv / 2 + cos({2 * math.pi!r}::DOUBLE * mx) / 2) / 3)), 6) AS bulk FROM fh JOIN m ON m.cell = fh.cell AND m.neighbour = fh.neighbour JOIN g ON g.id = fh.cell GROUP BY fh.cell""")
def periodic_integrals(spark, d):
    """A periodic integrand by the heuristic rule."""
    cells, _ = _periodic(spark, d).integrate(_wave, "heuristic")
    return cells.select("cell", F.round(F.col("bulk")[0], 6).alias("bulk"))


def _wave(x):
    import numpy as np

    return np.cos(2 * np.pi * x[:, :1])


@query(f"WITH {_G.replace('FROM supplier', 'FROM supplier WHERE s_suppkey % 7 <> 0')}, {_P}, {_PERIODIC} SELECT cell, array_to_string(list_sort(list_transform([3 * cell, n1, n2], {_OWNER})), ',') AS sigma, round((px % 1 + 1) % 1, 6) AS x0, round(py, 6) AS x1 FROM inc")
def periodic_transaction(spark, d):
    """A mesh of some sites, to which others are appended and from which others go in one transaction."""
    n = sites(spark, d)
    m = PeriodicMesh(n.filter("id % 5 <> 0"), Boundary.cuboid([1.0, 1.0], periodic={0})).compute()
    m.append(n.filter("id % 5 = 0 and id % 7 <> 0")).stage_removal(n.filter("id % 5 <> 0 and id % 7 = 0")).compute()
    return m.public_vertices().select("cell", _name(), *_xs("position", 2))


@query(f"WITH {_G} SELECT id AS ref_id, round(x + s, 6) AS x0, round(y, 6) AS x1 FROM g, (VALUES (-1), (1)) t(s)")
def periodic_references(spark, d):
    b = Boundary.cuboid([1.0, 1.0], periodic={0})
    i = images(sites(spark, d), b)
    return find_reference(i, i.filter("kind = 'reference'")).select("ref_id", *_xs("coords", 2))


#: Four points that no hemisphere holds, so that the sphere is covered however few sites there are.
_ANCHORS = [(0.1, 0.2, 1.0), (0.9, -0.1, -0.4), (-0.5, 0.8, -0.3), (-0.4, -0.9, -0.2)]


def _sphere(spark, d):
    x, y = _xy("s_acctbal", "s_suppkey")
    r = F.sqrt(1 - F.pow(2 * y - 1, F.lit(2.0)))
    own = tables.nodes(_read(spark, d, "supplier"), "s_suppkey", [r * F.cos(2 * math.pi * x), r * F.sin(2 * math.pi * x), 2 * y - 1])
    return own.unionByName(tables.from_points(spark, _ANCHORS, 1_000_000))


_ON_SPHERE = f"""s0 AS (SELECT id, sqrt(1 - (2 * y - 1) ** 2) * cos({2 * math.pi!r}::DOUBLE * x) AS a, sqrt(1 - (2 * y - 1) ** 2) * sin({2 * math.pi!r}::DOUBLE * x) AS b, 2 * y - 1 AS c FROM g
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({1_000_000 + i}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for i, (x, y, z) in enumerate(_ANCHORS))}) v(id, a, b, c))"""
_UNIT = "SELECT id, a / sqrt(a * a + b * b + c * c) AS a, b / sqrt(a * a + b * b + c * c) AS b, c / sqrt(a * a + b * b + c * c) AS c FROM s0"
# Triples of near points whose circle no other point is in; few points may be far from each other.
_TRIPLES = """q AS MATERIALIZED (SELECT p.id AS i, q.id AS j FROM s p JOIN s q ON p.id < q.id AND p.a * q.a + p.b * q.b + p.c * q.c > CASE WHEN (SELECT count(*) FROM s) > 60 THEN 0.1 ELSE -2 END
), t AS (SELECT p.id AS i, q.id AS j, r.id AS k, p.a, p.b, p.c, (q.b - p.b) * (r.c - p.c) - (q.c - p.c) * (r.b - p.b) AS nx, (q.c - p.c) * (r.a - p.a) - (q.a - p.a) * (r.c - p.c) AS ny, (q.a - p.a) * (r.b - p.b) - (q.b - p.b) * (r.a - p.a) AS nz
  FROM q e JOIN q f ON e.i = f.i AND e.j < f.j JOIN q ef ON ef.i = e.j AND ef.j = f.j JOIN s p ON p.id = e.i JOIN s q ON q.id = e.j JOIN s r ON r.id = f.j
), u AS (SELECT i, j, k, sgn, sgn * nx / sqrt(nx * nx + ny * ny + nz * nz) AS x, sgn * ny / sqrt(nx * nx + ny * ny + nz * nz) AS y, sgn * nz / sqrt(nx * nx + ny * ny + nz * nz) AS z, t.a, t.b, t.c FROM t, (VALUES (1), (-1)) v(sgn) WHERE nx * nx + ny * ny + nz * nz > 1e-24
), w AS (SELECT i, j, k, sgn, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM u, s GROUP BY i, j, k, sgn HAVING max(x * s.a + y * s.b + z * s.c - x * u.a - y * u.b - z * u.c) < 1e-9)"""
_PAIR = "(SELECT unnest([i, i, j, j, k, k]) AS cell, unnest([j, k, i, k, i, j]) AS neighbour FROM w)"
_CIRCLES = f"{_G}, {_ON_SPHERE}, s AS ({_UNIT}), {_TRIPLES}"
# Each site and its antipode, by canonical hemisphere: 2 id + 1 and 2 id + 2.
_TWINS = f"{_G}, {_ON_SPHERE}, s1 AS ({_UNIT}), s AS (SELECT 2 * id + CASE WHEN f = 1 THEN 1 ELSE 2 END AS id, f * sg * a AS a, f * sg * b AS b, f * sg * c AS c FROM (SELECT *, CASE WHEN a < 0 OR a = 0 AND (b < 0 OR b = 0 AND c < 0) THEN -1 ELSE 1 END AS sg FROM s1), (VALUES (1), (-1)) v(f)), {_TRIPLES}"


@query(f"WITH {_CIRCLES} SELECT i || ',' || j || ',' || k AS sigma, round(x, 5) AS x0, round(y, 5) AS x1, round(z, 5) AS x2 FROM w")
def spherical_vertices(spark, d):
    return SphericalMesh(_sphere(spark, d)).compute().vertices().select(_name(), *_xs("position", 3, 5))


@query(f"WITH {_CIRCLES} SELECT DISTINCT cell, neighbour, 0 AS occurrence FROM {_PAIR}")
def spherical_neighbours(spark, d):
    return SphericalMesh(_sphere(spark, d)).compute().neighbours()


@query(f"WITH {_TWINS} SELECT array_to_string(list_sort([(i - 1) // 2, (j - 1) // 2, (k - 1) // 2]), ',') AS sigma, round(x, 5) AS x0, round(y, 5) AS x1, round(z, 5) AS x2 FROM w WHERE CASE WHEN abs(x) > 1e-12 THEN x WHEN abs(y) > 1e-12 THEN y ELSE z END > 0")
def antipodal_vertices(spark, d):
    return SphericalMesh(_sphere(spark, d), antipodal=True).compute().vertices().select(_name(), *_xs("position", 3, 5))


@query(f"WITH {_TWINS} SELECT (cell - 1) // 2 AS cell, (neighbour - 1) // 2 AS neighbour, row_number() OVER (PARTITION BY cell, (neighbour - 1) // 2 ORDER BY neighbour) - 1 AS occurrence FROM (SELECT DISTINCT cell, neighbour FROM {_PAIR} WHERE cell % 2 = 1)")
def antipodal_neighbours(spark, d):
    return SphericalMesh(_sphere(spark, d), antipodal=True).compute().neighbours()


@query()
def voronoi_vertices_3d(spark, d):
    n = vectors(spark, d, 3)
    return VoronoiMesh.from_df(n, Boundary.centred_cube(3, 1.0)).vertices.select(_name(), *_xs("position", 3))


@query("SELECT CAST(1 AS DOUBLE) AS total")
def cell_volumes_3d_total(spark, d):
    """Volumes of all cells of the embeddings' first three components in the cube around them, as a share of it."""
    i = Integral(VoronoiMesh.from_df(vectors(spark, d, 3), Boundary.centred_cube(3, 1.0)).compute())
    i.integrate()
    return i.cells.agg(F.round(F.sum("volume") / 8, 6).alias("total"))
