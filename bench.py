"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

construct_* and integrate_* are the median of three runs, each from the node table
on, as the numbers that they stand beside are medians; all others run once.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def cases(spark):
    """Name to function; construct_* and integrate_*: uniform points in the unit cube, five dimensions."""
    from polycell.api import Integral, VoronoiMesh
    from polycell.operators import construct
    from polycell.plans.boundary import Boundary
    from polycell.plans.queries import QUERIES
    from polycell.sources import tables

    def cube(n, bounded):
        nodes = tables.from_points(spark, construct.splitmix_points(n, 5)).persist()
        nodes.count()
        return VoronoiMesh.from_df(nodes, Boundary.cuboid([1.0] * 5) if bounded else None)

    made = {f"construct_5d_{n}_{kind}": cube(n, kind == "bounded") for n in (1000, 2000) for kind in ("bounded", "open")}
    for name, m in made.items():
        yield name, lambda m=m: m.compute().vertices.count()

    def integral():
        i = Integral(made["construct_5d_1000_bounded"])
        i.integrate()
        total = i.cells.groupBy().sum("volume").first()[0]
        assert abs(total - 1) < 1e-6, total

    yield "integrate_5d_1000_fast_polygon", integral
    for name in ("voronoi_vertices", "mesh_neighbours", "cell_volumes", "search_knn", "search_knn_64d", "voronoi_vertices_3d", "cell_volumes_3d_total", "spherical_vertices", "monte_carlo_volumes"):
        yield name, lambda q=QUERIES[name]: q(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    try:
        from polycell.llm.queries import QUERIES as more
    except ImportError:
        more = {}
    for name, q in more.items():
        yield name, lambda q=q: q(spark, SF_DIR).write.format("noop").mode("overwrite").save()


def main() -> None:
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name, run in cases(spark):
        took = []
        for _ in range(3 if name.startswith(("construct", "integrate")) else 1):
            began = time.perf_counter()
            run()
            took.append(time.perf_counter() - began)
        seconds[name] = round(sorted(took)[len(took) // 2], 3)
        spark.catalog.clearCache() if not name.startswith("construct") else None
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
