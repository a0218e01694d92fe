"""Generator tables: from parquet columns, text files, other tables and analytic grids."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import vec

NODES = "id BIGINT, coords ARRAY<DOUBLE>, active BOOLEAN, kind STRING, ref_id BIGINT, shift ARRAY<INT>"


def nodes(df: DataFrame, id_col, coords, dim: int | None = None) -> DataFrame:
    """A node table from any table: an id and a vector column or a list of number columns."""
    coords = vec.point(*coords) if isinstance(coords, list | tuple) else F.col(coords).cast("array<double>") if isinstance(coords, str) else coords
    if dim is not None:
        coords = F.slice(coords, 1, dim)
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return df.select(id_col.cast("long").alias("id"), coords.alias("coords"), F.lit(True).alias("active"), F.lit("visible").alias("kind"), F.lit(None).cast("long").alias("ref_id"), F.lit(None).cast("array<int>").alias("shift"))


def from_points(spark: SparkSession, points, first_id: int = 0) -> DataFrame:
    """A node table of points given in Python, as node-major rows."""
    rows = [(first_id + i, [float(x) for x in p], True, "visible", None, None) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, NODES)


def set_points(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The node table with the coords of changes (id, coords) in the place of its own."""
    new = changes.select(F.col("id").alias("i"), F.col("coords").alias("c"))
    return table.join(new, F.col("id") == F.col("i"), "left").withColumn("coords", F.coalesce("c", "coords")).select(*table.columns)


def composite(*tables: DataFrame) -> DataFrame:
    """One index space over several node tables: ids of each follow those of the ones before."""
    out, offset = None, F.lit(0).cast("long")
    for t in tables:
        part = t.withColumn("id", F.col("id") + offset)
        size = t.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("n")).first()["n"]
        offset = offset + F.lit(size)
        out = part if out is None else out.unionByName(part)
    return out


def read_points_csv(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Points of a text file, a line per point; ids follow (file, line) order."""
    schema = ", ".join(f"x{i} DOUBLE" for i in range(dim))
    rows = spark.read.schema(schema).csv(path).withColumn("at", F.monotonically_increasing_id())
    parts = rows.groupBy(F.shiftright("at", 33).alias("p")).count().collect()  # a row per file split
    base, offsets = 0, []
    for r in sorted(parts):
        offsets += [F.lit(r["p"]), F.lit(base).cast("long")]
        base += r["count"]
    dense = (F.element_at(F.create_map(*offsets), F.shiftright("at", 33)) if offsets else F.lit(0)) + F.col("at").bitwiseAND((1 << 33) - 1)
    return nodes(rows, dense, [f"x{i}" for i in range(dim)])


def write_points_csv(table: DataFrame, path: str, dim: int) -> None:
    table.orderBy("id").select(*[F.col("coords")[i].alias(f"x{i}") for i in range(dim)]).write.mode("overwrite").csv(path)


# -- the analytic Cartesian grid ----------------------------------------------------------------


def _place(n, counts: list[int]) -> list:
    """Grid place of row n, last axis fastest."""
    out = []
    for k in range(len(counts)):
        step = prod(counts[k + 1 :])
        out.append(F.expr(f"cast({n} div {step} as bigint) % {counts[k]}"))
    return out


def cuboid_nodes(spark: SparkSession, start, spacing, counts: list[int]) -> DataFrame:
    """Nodes of a Cartesian grid, computed by arithmetic from their ids."""
    rows = spark.range(prod(counts))
    coords = vec.point(*[F.lit(float(a)) + F.lit(float(h)) * k for a, h, k in zip(start, spacing, _place("id", counts), strict=True)])
    return nodes(rows, "id", coords)


def cuboid_vertices(spark: SparkSession, start, spacing, counts: list[int]) -> DataFrame:
    """(sigma, position) of the grid's inner vertices: the 2**d nodes around each, and their middle."""
    d = len(counts)
    inner = [c - 1 for c in counts]
    rows = spark.range(prod(inner)) if min(inner) > 0 else spark.range(0)
    at = _place("id", [max(1, c) for c in inner])
    base = sum((k * prod(counts[i + 1 :]) for i, k in enumerate(at)), F.lit(0))
    corners = [sum(prod(counts[i + 1 :]) for i in range(d) if m >> i & 1) for m in range(1 << d)]
    sigma = F.array_sort(F.array(*[(base + c).cast("long") for c in corners]))
    position = vec.point(*[F.lit(float(a)) + F.lit(float(h)) * (k + 0.5) for a, h, k in zip(start, spacing, at, strict=True)])
    return rows.select(sigma.alias("sigma"), position.alias("position"))


def cuboid_neighbours(spark: SparkSession, counts: list[int]) -> DataFrame:
    """(cell, neighbour, occurrence) of facet neighbours on the grid."""
    at = _place("id", counts)
    steps = []
    for i, k in enumerate(at):
        step = prod(counts[i + 1 :])
        steps += [F.when(k > 0, F.col("id") - step), F.when(k < counts[i] - 1, F.col("id") + step)]
    rows = spark.range(prod(counts)).select(F.col("id").alias("cell"), F.explode(F.array_compact(F.array(*steps))).alias("neighbour"))
    return rows.withColumn("occurrence", F.lit(0))


def cuboid_cells(spark: SparkSession, spacing, counts: list[int]) -> DataFrame:
    """(cell, volume) of the grid's inner cells, computed; cells at the rim have no volume of their own."""
    size = prod(float(h) for h in spacing)
    at = _place("id", counts)
    rim = F.lit(False)
    for k, c in zip(at, counts, strict=True):
        rim = rim | (k == 0) | (k == c - 1)
    return spark.range(prod(counts)).select(F.col("id").alias("cell"), F.when(rim, float("inf")).otherwise(size).alias("volume"))


def cuboid_interfaces(spark: SparkSession, spacing, counts: list[int]) -> DataFrame:
    """(cell, neighbour, area) of the grid, computed; inf where a facet reaches the rim."""
    at, rows = _place("id", counts), []
    for i, k in enumerate(at):
        step = prod(counts[i + 1 :])
        area = prod(float(h) for j, h in enumerate(spacing) if j != i)
        rim = F.lit(False)
        for j, c in enumerate(counts):
            if j != i:
                rim = rim | (at[j] == 0) | (at[j] == c - 1)
        size = F.when(rim, float("inf")).otherwise(area)
        rows += [F.struct(F.when(k > 0, F.col("id") - step).alias("neighbour"), size.alias("area")), F.struct(F.when(k < counts[i] - 1, F.col("id") + step).alias("neighbour"), size.alias("area"))]
    return spark.range(prod(counts)).select(F.col("id").alias("cell"), F.explode(F.array(*rows)).alias("r")).select("cell", "r.neighbour", "r.area").filter("neighbour is not null")


class CuboidMesh:
    """The grid as a mesh that is read only: its tables are computed when they are asked for."""

    def __init__(self, spark: SparkSession, start, spacing, counts: list[int]):
        self.spark, self.start, self.spacing, self.counts = spark, start, spacing, counts

    @property
    def nodes(self) -> DataFrame:
        return cuboid_nodes(self.spark, self.start, self.spacing, self.counts)

    @property
    def vertices(self) -> DataFrame:
        return cuboid_vertices(self.spark, self.start, self.spacing, self.counts)

    def neighbours(self) -> DataFrame:
        return cuboid_neighbours(self.spark, self.counts)

    @property
    def cells(self) -> DataFrame:
        return cuboid_cells(self.spark, self.spacing, self.counts)

    @property
    def interfaces(self) -> DataFrame:
        return cuboid_interfaces(self.spark, self.spacing, self.counts)


def without_erased(engine_rows: DataFrame, stored_rows: DataFrame, erased: DataFrame) -> DataFrame:
    """Vertices of an analytic engine and of a store in one table, less the engine's erased ones."""
    return engine_rows.join(erased.select("sigma"), "sigma", "left_anti").unionByName(stored_rows.select(*engine_rows.columns)).dropDuplicates(["sigma"])


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _CuboidReader(DataSourceReader):
    def __init__(self, options):
        numbers = lambda k, f: [f(x) for x in options[k].split(",")]
        self.start, self.spacing, self.counts = numbers("start", float), numbers("spacing", float), numbers("counts", int)
        self.parts = int(options.get("partitions", 8))

    def partitions(self):
        n = prod(self.counts)
        size = -(-n // self.parts) or 1
        return [_Range(a, min(n, a + size)) for a in range(0, n, size)] or [_Range(0, 0)]

    def read(self, partition):
        for n in range(partition.lo, partition.hi):
            at, rest = [], n
            for c in reversed(self.counts):
                rest, k = divmod(rest, c)
                at.append(k)
            yield n, [a + h * k for a, h, k in zip(self.start, self.spacing, reversed(at), strict=True)]


class CuboidSource(DataSource):
    """``spark.read.format("cuboid").option("start", "0,0")...``: a pluggable engine of computed nodes."""

    @classmethod
    def name(cls):
        return "cuboid"

    def schema(self):
        return "id bigint, coords array<double>"

    def reader(self, schema):
        return _CuboidReader(dict(self.options))
