"""Embedding near-duplicates by sorted projection passes.

A pass gives each vector the signs of many random projections, one after the
other, as a sort key; vectors are put in the order of that key, and each is
compared with its neighbours in a bounded window. Verified pairs of all passes are
united to components. The number of passes follows first from the number of
vectors and the wanted recall at the threshold, as if directions were spread
evenly. Where many vectors lie close together without being linked, keys tell them
apart badly; so the recall is measured: all vectors are compared with a bounded
sample of them, and passes go on, twice as many and with wider windows each time,
until the components hold the wanted share of the sample's links.

Windows are bounded, groups of near copies aren't: within each component, links
are then counted exactly. Where all members lie within half the threshold angle
of the component's mean, all of them are linked, which needs no comparison; other
members are compared in tiles of bounded size that yield counts, not pairs.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binary_rows, components, list_rows, matrix, summed_sketch, table, width

#: Bits of a sort key.
KEY_BITS = 62
WINDOW, WIDEST = 64, 1024
TILE, STRIP = 4096, 512
_BLOCK = 1024
#: Vectors that the recall is measured with.
SAMPLE = 1024


def _unit(column) -> np.ndarray:
    x = matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return x / np.linalg.norm(x, axis=1)[:, None]


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors of x and y are linked. Pairs next to the threshold are settled by a sum that no blocking changes."""
    dots = x @ y.T
    near = dots >= cosine
    for i, j in np.argwhere(np.abs(dots - cosine) < 1e-13):
        near[i, j] = math.fsum(x[i] * y[j]) >= cosine
    return near


def packed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, ok): vectors as bytes of doubles; not ok: null, zero, or with null or non-finite components."""

    def rows(batches):
        for b in batches:
            flat, offsets, ok = list_rows(b.column(1))
            sizes = np.diff(offsets)
            scale = np.zeros(len(ok))
            if ok.any():
                scale[ok] = np.maximum.reduceat(np.abs(flat[np.repeat(ok, sizes)]), np.cumsum(sizes[ok]) - sizes[ok])
            ok &= scale > 0
            kept = flat[np.repeat(ok, sizes)]
            extreme = ok & ~((scale > 1e-100) & (scale < 1e100))
            if extreme.any():  # squares stay finite
                kept = kept / np.repeat(np.where(extreme, scale, 1.0)[ok], sizes[ok])
            place = np.where(ok, np.cumsum(ok) - 1, 0)
            v = binary_rows(kept.astype("<f8"), sizes[ok] * 8).take(pa.array(place, mask=~ok))
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(ok)], ["vec_id", "v", "ok"])

    return df.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(rows, "vec_id long, v binary, ok boolean")


def passes_for(n: int, cosine: float, recall: float, window: int = WINDOW) -> int:
    """Passes after which a pair at the threshold has been neighbours with probability ``recall``.

    A projection separates the pair with probability angle / pi; they are
    neighbours where they agree on the log2(n / window) bits that tell windows
    apart.
    """
    bits = max(1.0, math.log2(max(n, 2) / window))
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 4


def _keys(x: np.ndarray, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], KEY_BITS))
    return (x @ planes > 0).astype(np.int64) @ (np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))


def _links(x: np.ndarray, cosine: float) -> np.ndarray:
    """For each row, the first row of its component by links within the block."""
    near = linked(x, x, cosine)
    label = np.arange(len(x))
    some = np.flatnonzero(near.sum(axis=1) > 1)
    if not len(some):
        return label
    near = near[np.ix_(some, some)]
    own = some.copy()
    while True:
        low = np.where(near, own[None, :], len(x)).min(axis=1)
        if (low == own).all():
            break
        own = low
    label[some] = own
    return label


def candidate_links(spark: SparkSession, classes: DataFrame, n: int, cosine: float, passes: range, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Links (a, b) from some passes; within a block of neighbours, each component's members are linked to its first."""
    block = max(_BLOCK, window)

    def keyed(batches):
        for b in batches:
            sizes = np.asarray(pc.binary_length(b.column(1)))
            for size in np.unique(sizes):
                own = b.take(pa.array(np.flatnonzero(sizes == size)))
                x = _unit(own.column(1))
                for p in passes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p * 100_000 + size // 8, np.int64)), pa.array(_keys(x, p)), own.column(0), own.column(1)], ["pass", "k", "cid", "v"])

    names = ["a", "b", "task", "side", "pass", "v"]

    def windows(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        head, n_head, tail = [], 0, None

        def found(t: pa.Table):
            number, cid = t["pass"].to_numpy(), t["cid"].to_numpy()
            edges = np.flatnonzero(np.diff(number)) + 1
            for a, z in zip([0, *edges], [*edges, len(number)], strict=True):
                for s in range(a, z, block):
                    lo, hi = max(a, s - window), min(z, s + block)
                    if hi - lo < 2:
                        continue
                    label = _links(_unit(t["v"].slice(lo, hi - lo)), cosine)
                    moved = np.flatnonzero(label != np.arange(len(label)))
                    if len(moved):
                        yield pa.RecordBatch.from_arrays([pa.array(cid[lo + moved]), pa.array(cid[lo + label[moved]]), *(pa.nulls(len(moved), kind) for kind in (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if n_head < window:
                head.append(t.slice(0, window - n_head))
                n_head += len(head[-1])
            if tail is not None:
                t = pa.concat_tables([tail, t])
            yield from found(t)
            tail = t.slice(max(0, len(t) - window))
        for side, parts in ((0, head), (1, [tail] if tail is not None else [])):
            for t in parts:
                t = t.combine_chunks()
                yield pa.RecordBatch.from_arrays([t["cid"].combine_chunks(), t["cid"].combine_chunks(), pa.array(np.full(len(t), task, np.int64)), pa.array(np.full(len(t), side, np.int32)), t["pass"].combine_chunks(), t["v"].combine_chunks()], names)

    def seams(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))  # two windows of one pass at most
        cid = t["a"].to_numpy()
        if len(cid) > 1:
            label = _links(_unit(t["v"]), cosine)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(cid[moved]), pa.array(cid[label[moved]])], ["a", "b"])

    parts = max(width(spark), n * len(passes) // 200_000)
    order = classes.select("cid", "v").mapInArrow(keyed, "pass long, k long, cid long, v binary").repartitionByRange(parts, "pass", "k", "cid").sortWithinPartitions("pass", "k", "cid")
    found = scratch.save(order.mapInArrow(windows, "a long, b long, task long, side int, pass long, v binary"), "windows")
    # The end of a partition is compared with the beginning of the next one that has rows.
    tasks = sorted(r["task"] for r in found.filter("side = 0").select("task").distinct().collect())  # a row per partition at most
    ends = found.filter("side is not null")
    if tasks:
        ranked = spark.createDataFrame(list(enumerate(tasks)), "seam long, task long")
        ends = ends.join(ranked, "task").withColumn("seam", F.col("seam") + F.col("side"))
        return found.filter("side is null").select("a", "b").union(ends.groupBy("seam", "pass").applyInArrow(seams, "a long, b long"))
    return found.filter("side is null").select("a", "b")


def measured_recall(classes: DataFrame, label: DataFrame, cosine: float, scratch: Scratch, sample: int = SAMPLE) -> float:
    """Share of a sample's links that lie within components; the sample, those with the smallest hashes, meets all vectors.

    The smaller one of the share of all links and of the mean share per vector.
    """
    rows = classes.select("cid", "v").join(label.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "v", F.coalesce("component", "cid").alias("component"))
    picked = rows.orderBy(F.xxhash64("cid"), "cid").limit(sample).collect()
    if not picked:
        return 1.0
    by_size: dict[int, list[int]] = {}
    for i, r in enumerate(picked):
        by_size.setdefault(len(r["v"]), []).append(i)
    own = {size: (np.array(at), _unit(pa.array([bytes(picked[i]["v"]) for i in at], pa.binary())), *(np.array([picked[i][c] for i in at]) for c in ("cid", "component"))) for size, at in by_size.items()}
    shared, m = scratch.share(own), len(picked)

    def count(batches):
        out = np.zeros(2 * m, np.uint64)
        for b in batches:
            sizes = np.asarray(pc.binary_length(b.column(1)))
            for size in np.unique(sizes):
                if size not in shared.value:
                    continue
                at, y, cid, component = shared.value[size]
                part = b.take(pa.array(np.flatnonzero(sizes == size)))
                x, mine, its = _unit(part.column(1)), part.column(0).to_numpy(), part.column(2).to_numpy()
                for s in range(0, len(x), STRIP):
                    near = linked(x[s : s + STRIP], y, cosine) & (mine[s : s + STRIP, None] != cid[None, :])
                    out[at] += near.sum(axis=0).astype(np.uint64)
                    out[m + at] += (near & (its[s : s + STRIP, None] == component[None, :])).sum(axis=0).astype(np.uint64)
        return out

    got = summed_sketch(rows, count, 2 * m).astype(float)
    scratch.release()
    all_, held = got[:m], got[m:]
    if not all_.any():
        return 1.0
    return min(held.sum() / all_.sum(), (held[all_ > 0] / all_[all_ > 0]).mean())


def near_duplicates(spark: SparkSession, df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.98, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Links join vectors of the same length whose cosine, in double precision, is at
    least ``cosine``. n_links counts other rows linked directly, component_id is
    the smallest vec_id reachable, kept is vec_id = component_id. A vector that is
    null, empty or zero, or has null or non-finite components, links with nothing:
    0 links, its own component. Equal vectors are one class that is compared once
    and counted as often as it occurs. Rows with the same vec_id give a row each.
    """
    scratch = Scratch(spark)
    rows = scratch.save(packed(df, id_col, vec_col).withColumn("cid", F.when(F.col("ok"), F.xxhash64("v"))), "vectors")
    classes = scratch.save(rows.filter("ok").groupBy("cid").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v")), "classes")
    n = classes.count()
    done, links, wide = 0, None, window
    while True:
        passes = range(done, 2 * done or passes_for(n, cosine, recall, window))
        more = candidate_links(spark, classes, n, cosine, passes, scratch, wide)
        links = more if links is None else links.union(more)
        label = components(spark, links, scratch)
        done, share = passes.stop, measured_recall(classes, label, cosine, scratch)
        if share >= recall:
            break
        if done * wide >= n:
            warnings.warn(f"near duplicates: {share:.3f} of the sampled links are found after {done} passes", stacklevel=2)
            break
        wide = min(2 * wide, max(WIDEST, window))
    members = scratch.save(classes.join(label.withColumnRenamed("node", "cid"), "cid"), "members")
    counts = link_counts(spark, members, cosine, scratch)
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    known = members.select("cid", "component").join(least, "component").join(counts, "cid", "left").select("cid", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    named = classes.select("cid", "least", "m").join(known, "cid", "left").select("cid", "m", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.select("vec_id", "cid").join(named, "cid", "left")
    out = out.select("vec_id", F.coalesce(F.col("links") + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def link_counts(spark: SparkSession, members: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """(cid, links): rows of other classes of the component within the threshold, exactly."""
    half = math.acos(cosine) / 2 - 1e-7

    def sums(batches):
        from pyspark import TaskContext

        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.asarray(pc.binary_length(b.column(1)))
            for size in np.unique(sizes):  # a component's vectors are of one length
                own = b.take(pa.array(np.flatnonzero(sizes == size)))
                names, inverse = np.unique(own.column(0).to_numpy(), return_inverse=True)
                total = np.zeros((len(names), size // 8))
                np.add.at(total, inverse, _unit(own.column(1)))
                group = np.full(len(names), TaskContext.get().partitionId() % 32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(group), binary_rows(total, np.full(len(names), size))], ["component", "g", "s"])

    def add(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            total = total + matrix(b.column("s")).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["component", "s"])

    def inner(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sizes, near = np.asarray(pc.binary_length(b.column("v"))), np.zeros(b.num_rows, bool)
            for length in np.unique(sizes):
                at = np.flatnonzero(sizes == length)
                own = b.take(pa.array(at))
                x, s = _unit(own.column("v")), matrix(own.column("s"))
                size = np.linalg.norm(s, axis=1)
                near[at] = ((x * s).sum(axis=1) >= math.cos(half) * size) & (size > 0)
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("component"), b.column("m"), b.column("v"), pa.array(near)], ["cid", "component", "m", "v", "core"])

    # Tasks' sums are added in groups of tasks first, so that no task gets a row of every task for a large component.
    centre = members.select("component", "v").mapInArrow(sums, "component long, g int, s binary").groupBy("component", "g").applyInArrow(add, "component long, s binary").groupBy("component").applyInArrow(add, "component long, s binary")
    rows = scratch.save(members.join(centre, "component").select("cid", "component", "m", "v", "s").mapInArrow(inner, "cid long, component long, m long, v binary, core boolean"), "core")
    sizes = rows.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("m")).otherwise(0)).alias("core_m"), F.count(F.lit(1)).alias("all"), F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("outer"))
    rows = rows.join(sizes, "component")
    of_core = rows.filter("core").select("cid", (F.col("core_m") - F.col("m")).alias("links"))

    # Pairs with a member outside the core: its tiles against all tiles of the component.
    tile = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), tile(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("cid"), tile(c)).cast("int")
    rest = rows.filter("outer > 0")
    left = rest.filter("not core").select("component", own("outer").alias("i"), spread("all").alias("j"), "cid", "m", "v", "core", F.lit(True).alias("left"))
    right = rest.select("component", spread("outer").alias("i"), own("all").alias("j"), "cid", "m", "v", "core", F.lit(False).alias("left"))

    def compare(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))  # a tile of either side
        side = t["left"].to_numpy()
        if not side.any() or side.all():
            return
        cid, m, core = t["cid"].to_numpy(), t["m"].to_numpy(), t["core"].to_numpy()
        x = _unit(t["v"])
        left, right, weight, of_right = x[side], x[~side], m[~side], np.zeros((~side).sum(), np.int64)
        of_left = np.zeros(len(left), np.int64)
        for s in range(0, len(left), STRIP):
            near = linked(left[s : s + STRIP], right, cosine) & (cid[side][s : s + STRIP, None] != cid[~side][None, :])
            of_left[s : s + STRIP] = near @ weight
            of_right += m[side][s : s + STRIP] @ near
        inner = core[~side]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cid[side], cid[~side][inner]])), pa.array(np.concatenate([of_left, of_right[inner]]))], ["cid", "links"])

    pieces = left.unionByName(right).groupBy("component", "i", "j").applyInArrow(compare, "cid long, links long")
    return of_core.union(pieces).groupBy("cid").agg(F.sum("links").alias("links"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_embedding_near_dedup": op5_embedding_near_dedup}
SQL = {
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), l AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT vec_id, coalesce(l.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN l ON l.a = vec_id
"""
}
