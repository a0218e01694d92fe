"""Exact top-k search by integer inner product over a bit-sliced index.

Rows are dealt to blocks. A block's index has a bitmap for every bit of every
component, over the block's rows in order of id: once of component - least and
once of greatest - component, so that only non-negative numbers are added
whatever the sign of the query's component. A query's scores of all rows of a
block come from adding the slices of its components, shifted by the set bits of
the query, with full adders over bitmaps. The top rows are then selected from
the most significant slice downward; rows that are still tied at the boundary
after the last slice are resolved exactly, by id. The selected rows' scores are
inner products of the integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import binary_rows, list_rows, matrix, table, width

#: Rows of a block, at most about, and of one that is made for the sake of parallel tasks.
BLOCK_ROWS, LEAST_ROWS = 65_536, 2048
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component as bytes of int64; vectors that are null, empty or have null or non-finite components are left out.

    Scores must fit a long: a vector whose integers' squares sum up to 2**62 or
    more is an error.
    """

    def rows(batches):
        for b in batches:
            flat, offsets, ok = list_rows(b.column(1))
            keep = np.flatnonzero(ok)
            sizes = np.diff(offsets)[keep]
            q = np.floor(scale * flat[np.repeat(ok, np.diff(offsets))])
            if len(q) and (np.add.reduceat(q * q, np.cumsum(sizes) - sizes) >= 2.0**62).any():
                raise ValueError("a vector is too large: its inner products may not fit 64 bits")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), binary_rows(q.astype("<i8"), sizes * 8)], ["vec_id", "q"])

    return df.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(rows, "vec_id long, q binary")


class SlicedIndex:
    """Bit slices of the rows of a block (integers, none null, one row at least), which are in order of id."""

    def __init__(self, x: np.ndarray):
        self.rows, self.dims = x.shape
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.bits = max(1, int((self.high - self.low).max()).bit_length())
        self.words = -(-self.rows // 64)
        self.up, self.down = self._slices(x - self.low), self._slices(self.high - x)
        full = np.zeros(self.words * 64, bool)
        full[: self.rows] = True
        self.valid = np.packbits(full, bitorder="little").view(np.uint64)

    def _slices(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.dims, self.bits, self.words * 64), bool)
        for s in range(self.bits):
            out[:, s, : self.rows] = (x.T >> s) & 1
        return np.packbits(out, axis=2, bitorder="little").view(np.uint64)

    def add(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of score(row) less the query's least possible score in the block."""
        piles: dict[int, list] = {}
        for j in np.flatnonzero(q):
            slices, size = (self.up[j], int(q[j])) if q[j] > 0 else (self.down[j], -int(q[j]))
            for b in range(size.bit_length()):
                if size >> b & 1:
                    for s in range(self.bits):
                        piles.setdefault(s + b, []).append(slices[s])
        out, place, carried = [], 0, None
        while place <= max(piles, default=-1) or carried is not None:
            pile = piles.get(place, [])
            pile = np.array(pile) if pile else np.zeros((0, self.words), np.uint64)
            if carried is not None:
                pile = np.concatenate([pile, carried])
            carry = []
            while len(pile) > 2:
                t = len(pile) // 3
                a, b, c = pile[:t], pile[t : 2 * t], pile[2 * t : 3 * t]
                ab = a ^ b
                carry.append((a & b) | (c & ab))
                pile = np.concatenate([ab ^ c, pile[3 * t :]])
            if len(pile) == 2:
                carry.append((pile[:1] & pile[1:]))
                pile = pile[:1] ^ pile[1:]
            out.append(pile[0] if len(pile) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(carry) if carry else None
            place += 1
        return out

    def top(self, q: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
        """Places of the k best rows, ties to smaller places; rows at the places ``skip`` take no part."""
        tied = self.valid.copy()
        for r in skip:
            tied[r >> 6] &= ALL ^ (np.uint64(1) << np.uint64(r & 63))
        sure = np.zeros_like(tied)
        if int(np.bitwise_count(tied).sum()) > k:
            for s in reversed(self.add(q)):
                more = sure | (tied & s)
                n = int(np.bitwise_count(more).sum())
                if n > k:
                    tied &= s
                else:
                    sure = more
                    tied &= ~s
                    if n == k:
                        break
        best = self._places(sure)
        return np.concatenate([best, self._places(tied)[: k - len(best)]])

    @staticmethod
    def _places(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_k(spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by inner product of rows (vec_id, q).

    Ties go to the smaller vec_id. Rows with the query's own vec_id take no part;
    other repeated rows count as often as they occur. Equal rows of ``queries``
    are one query; different vectors under one vec_id are queries of their own.
    Vectors are compared with those of the same length only.

    Each block's rows go to its task once, and its index is built once; then the
    queries stream past it. Rows are dealt to blocks by their place in the input,
    so equal rows don't meet in one block.
    """
    n = rows.count()
    blocks = max(1, -(-n // block_rows), min(width(spark), -(-n // LEAST_ROWS)))
    a = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.octet_length("q").alias("size"), F.lit(False).alias("asks"), "vec_id", "q")
    b = queries.distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.octet_length("q").alias("size"), F.lit(True).alias("asks"), "vec_id", "q")

    def search(batches):
        index, held, now = None, [], None
        for batch in batches:
            block, size, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "size", "asks"))
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(size) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for s, e in zip([0, *edges], [*edges, len(block)], strict=True):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                if (block[s], size[s]) != now:
                    index, held, now = None, [], (block[s], size[s])
                ids, x = part.column("vec_id").to_numpy(), matrix(part.column("q"), "<i8")
                if not asks[s]:
                    held.append((ids, x))
                    continue
                if not held and index is None:
                    continue
                if index is None:
                    ids_of, x_of = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    order = np.argsort(ids_of, kind="stable")
                    ids_of, x_of, held = ids_of[order], x_of[order], []
                    index = SlicedIndex(x_of)
                for v, name, raw in zip(x, ids.tolist(), part.column("q"), strict=True):
                    found = index.top(v, k, np.arange(*np.searchsorted(ids_of, [name, name + 1])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), name, np.int64)), pa.repeat(raw, len(found)), pa.array(ids_of[found]), pa.array(x_of[found] @ v)], ["query_id", "q", "vec_id", "score"])

    dealt = a.unionByName(b).repartition(blocks, "block").sortWithinPartitions("block", "size", "asks")
    found = dealt.mapInArrow(search, "query_id long, q binary, vec_id long, score long")
    w = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: vectors whose vec_id is divisible by 100, against all; vectors without an id take no part."""
    rows = quantised(table(spark, sf_dir, "embeddings").filter("vec_id is not null"), "vec_id", "embedding", 1024)
    return top_k(spark, rows, rows.filter("vec_id % 100 = 0"), 10)


QUERIES = {"op9_exact_top_k": op9_exact_top_k}
SQL = {
    "op9_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
