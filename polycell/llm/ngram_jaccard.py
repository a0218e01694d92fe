"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row for each distinct shingle set and a column for
each n-gram. A pair's overlap is an entry of the product of the matrix with its
own transpose. Only those entries are accumulated that can still reach the
threshold:

1. Columns are put in one global order, rare n-grams first. The order comes from
   counts of all n-grams of all documents in a table of fixed size; any order
   gives the same result, a good one keeps columns short.
2. A row enters the product with its first n - ceil(t n) + 1 columns only: two
   sets that reach the threshold t share one of these (prefix filter).
3. Large groups of near copies would make columns with every pair of the group.
   So each column is first linked to a few hub rows; pairs with enough shared
   columns are verified exactly and joined to components. Then the product is
   accumulated, column block by column block, over pairs of rows that are not
   connected yet; the rows of a column are cut to blocks of ``BLOCK_ROWS``, and each
   pair of blocks is multiplied on its own. Pairs below the bounds that follow from their sizes, positions,
   bitmaps and accumulated overlap are discarded; all others are verified exactly
   on whole sets. (A set's bitmap has the parity of its n-grams in each of 512
   hash cells. Where two bitmaps differ, the sets differ in an n-gram at least,
   so the bitmaps bound the overlap from above.) No link that joins two components is lost; a pair within a
   component that exists already is not looked at again.

Sets are fetched in another pass over the texts, for rows of candidate pairs
only, so that whole sets are never shuffled for all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bitmap, components, in_bitmap, is_empty, summed_sketch, table, tidy
from .textkernel import chunks, mix, shingle_hashes, word_hashes

#: Bits of a set's bitmap (a multiple of 64).
BITS = 512
#: Counters of the table that orders the n-grams.
COUNTERS = 1 << 21
#: Rows of a column's block in the product.
BLOCK_ROWS = 256


def _bucket(grams: np.ndarray, counters: int) -> np.ndarray:
    return (grams >> np.uint64(64 - (counters - 1).bit_length())).astype(np.int64)


def gram_counts(docs: DataFrame, text_col: str, k: int, counters: int = COUNTERS) -> np.ndarray:
    """How many n-grams of all documents fall to each counter (fixed size, over all rows), as 2048 times the logarithm."""

    def count(batches):
        total = np.zeros(counters, np.uint64)
        held, size = [], 0
        for b in batches:
            for _, data, offsets in chunks(b.column(0)):
                grams, _ = shingle_hashes(*word_hashes(data, offsets), k)
                held.append(_bucket(grams, counters).astype(np.int32))
                size += len(grams)
                if size > 1 << 21:
                    total += np.bincount(np.concatenate(held), minlength=counters).astype(np.uint64)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=counters).astype(np.uint64)
        return total

    return summed_sketch(docs.select(F.col(text_col)), count, counters, lambda n: np.minimum(np.log2(n + 1.0) * 2048, 65535), "<u2")


def _key(grams: np.ndarray) -> int:
    """64-bit name of a sorted set of n-grams."""
    with np.errstate(over="ignore"):
        h = mix(grams + np.uint64(0x51ED270B)).sum(dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(len(grams))
    return int(mix(np.array([h], np.uint64)).view(np.int64)[0])


def bitmap_of(grams: np.ndarray) -> np.ndarray:
    """Parity of the n-grams in each hash cell, as bytes."""
    return np.packbits(np.bincount((grams & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1)


def prefix_rows(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, counts) -> DataFrame:
    """(doc_id, row_key, n, key, bits, prefix): size, name and bitmap of each document's set, its first columns in the global order."""

    def rows(batches):
        order = counts.value
        for b in batches:
            ids, row_keys, column = b.columns
            for row, data, offsets in chunks(column):
                grams, ends = shingle_hashes(*word_hashes(data, offsets), k)
                n = np.zeros(len(offsets) - 1, np.int32)
                keys = np.zeros(len(n), np.int64)
                bits = np.zeros((len(n), BITS // 8), np.uint8)
                parts, sizes = [], np.zeros(len(n) + 1, np.int64)
                for i in range(len(n)):
                    if ends[i] == ends[i + 1]:
                        continue
                    own = np.unique(grams[ends[i] : ends[i + 1]])
                    n[i], keys[i] = len(own), _key(own)
                    bits[i] = bitmap_of(own)
                    p = len(own) - -(-num * len(own) // den) + 1
                    often = order[_bucket(own, len(order))]
                    parts.append(own[np.lexsort((own, often))[:p]])
                    sizes[i + 1] = p
                flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                prefix = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat.view(np.int64), pa.int64()))
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (BITS // 64), pa.int32()), pa.array(bits.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(n)), row_keys.slice(row, len(n)), pa.array(n), pa.array(keys), words, prefix], ["doc_id", "row_key", "n", "key", "bits", "prefix"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("h"), F.col(text_col)).mapInArrow(rows, "doc_id long, row_key long, n int, key long, bits array<long>, prefix array<long>")


def whole_sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted) -> DataFrame:
    """(key, grams): the sets of those documents whose id is in the filter ``wanted``."""

    def rows(batches):
        words = wanted.value
        for b in batches:
            keep = np.flatnonzero(in_bitmap(b.column(0).to_numpy(zero_copy_only=False), words))
            if not len(keep):
                continue
            for _, data, offsets in chunks(b.column(1).take(pa.array(keep))):
                grams, ends = shingle_hashes(*word_hashes(data, offsets), k)
                sets = [np.unique(grams[ends[i] : ends[i + 1]]) for i in range(len(offsets) - 1)]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["key", "grams"])

    return docs.select(F.xxhash64(F.col(id_col).cast("long")), F.col(text_col)).mapInArrow(rows, "key long, grams binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose sets have den * |both| >= num * |either|."""
    left = sets.select(F.col("key").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("grams").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def test(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(test, "a long, b long")


def _bound(num: int, den: int, a: str = "na", b: str = "nb") -> str:
    """SQL of the least overlap with which sets of two sizes reach num / den: ceil(num (a + b) / (num + den))."""
    return f"((cast({num} as bigint) * ({a} + {b}) + {num + den - 1}) div {num + den})"


def link_classes(spark: SparkSession, scratch: Scratch, classes: DataFrame, sets_of, num: int, den: int, ordered: bool, hubs: int = 3) -> DataFrame:
    """(node, component) of classes (key, n, copies, bits, marks) that are linked with another one.

    marks: the columns that a class enters the product with; two classes are
    compared if they share one. ordered: marks are prefixes in one global order,
    so that the bounds on places and on the prefixes' overlap hold. sets_of(pairs)
    returns (key, grams) of the classes in pairs (a, b).
    """
    words = BITS // 64
    entries = classes.select("key", "n", F.least("copies", F.lit(1 << 30)).cast("int").alias("copies"), F.posexplode("marks").alias("pos", "gram"))
    lengths = entries.groupBy("gram").count().filter("count > 1").select("gram")
    columns = entries.join(lengths, "gram").select("gram", "key", "n", "copies", "pos")
    columns = columns.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num if num < den else 1.1)))
    columns = scratch.save(columns, "columns")
    # Near copies are most often near the text that is copied most.
    named = [F.max(F.struct("copies", "key", "n")).alias("hub0")]
    named += [F.min(F.struct(F.xxhash64(F.col("key"), F.lit(s)).alias("h"), "key", "n")).alias(f"hub{s}") for s in range(1, hubs)]
    heads = columns.groupBy("gram", "size_class").agg(F.count(F.lit(1)).alias("c"), *named).filter("c > 1")

    reach = f"{_bound(num, den)} <= least(na, nb)"
    # Of the overlap of a pair, what isn't within both prefixes is beyond one of them.
    prefix = lambda n: f"({n} - (({num} * cast({n} as bigint) + {den - 1}) div {den}) + 1)"
    needed = f"{_bound(num, den)} - greatest(na - {prefix('na')}, nb - {prefix('nb')})" if ordered else "1"
    apart = " + ".join(f"bit_count(xa[{i}] ^ xb[{i}])" for i in range(words))
    close = f"{apart} <= na + nb - 2 * {_bound(num, den)}"

    each = F.array_distinct(F.array(*[F.struct(F.col(f"hub{s}.key").alias("b"), F.col(f"hub{s}.n").alias("nb")) for s in range(hubs)]))
    star = columns.join(heads, ["gram", "size_class"]).select("gram", F.col("key").alias("a"), F.col("n").alias("na"), F.explode(each).alias("hub")).select("gram", "a", "na", "hub.b", "hub.nb").filter("a <> b").filter(reach)
    star = star.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count_distinct("gram").alias("shared")).filter(f"shared >= {needed}")
    sized = lambda c: classes.select(F.col("key").alias(c), F.col("bits").alias(f"x{c}"))
    star = star.join(sized("a"), "a").join(sized("b"), "b").filter(close).select("a", "b", F.expr(apart).alias("gap"))
    # Of its hubs, each row is tried with the nearest and one more; other pairs wait for the product.
    star = star.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("s"), F.min(F.struct(F.xxhash64("b"), "b")).alias("t"))
    star = star.select("a", F.explode(F.array(F.col("s.b"), F.col("t.b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    star = scratch.save(star, "star")
    links = _links(scratch, star, sets_of, num, den)
    tidy(spark)
    label = components(spark, links, scratch)

    # The product over the rows of columns that are not connected yet.
    known = columns.join(label.select(F.col("node").alias("key"), "component"), "key", "left").select("gram", "key", "n", "pos", F.coalesce("component", "key").alias("part"))
    split = known.groupBy("gram").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).filter("lo <> hi").select("gram", "blocks")
    open_ = scratch.save(known.join(split, "gram").join(classes.select("key", "bits"), "key"), "open")
    # A column's rows are dealt to blocks; each pair of a column's blocks is a cell of the product, so a long column is no hot group.
    own, every = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda c, i, j: open_.select("gram", i.alias("i"), j.alias("j"), F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("pos").alias(f"p{c}"), F.col("part").alias(f"c{c}"), F.col("bits").alias(f"x{c}"))
    x, y = side("a", own, every), side("b", every, own)
    place = f"and {_bound(num, den)} <= least(pa, pb) + 1 + least(na - pa - 1, nb - pb - 1)" if ordered else ""
    product = x.join(y, (x.gram == y.gram) & (x.i == y.i) & (x.j == y.j) & F.expr(f"a < b and ca <> cb and {reach} {place} and {close}"))
    # No entry of a pair that reaches the threshold fails the test of places, so for such a pair the sum is the whole overlap of the prefixes.
    product = product.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count(F.lit(1)).alias("shared"))
    rest = scratch.save(product.filter(f"shared >= {needed}").select("a", "b"), "rest")
    scratch.drop(columns, open_)
    if not is_empty(rest):
        label = components(spark, links.union(_links(scratch, rest, sets_of, num, den)), scratch)
    return label


def _links(scratch: Scratch, pairs: DataFrame, sets_of, num: int, den: int) -> DataFrame:
    """Those of the pairs that are verified on whole sets, written."""
    if is_empty(pairs):
        return pairs
    sets = scratch.save(sets_of(pairs), "sets")
    scratch.release()
    out = scratch.save(_verified(pairs, sets, num, den), "links")
    scratch.drop(sets, pairs)
    return out


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Links documents whose sets of k-word shingles have Jaccard similarity >= num / den.

    Returns a row per row of ``docs``: doc_id, row_key (xxhash64 of id and text),
    n_shingles, class_id (smallest doc_id with the same set), component_id
    (smallest doc_id reachable by links) and part (the component's own key, which
    no two components share, whatever their ids; null without shingles). Words are runs of anything but ASCII white space, A-Z lower-cased. A
    text with fewer than k words has the whole sequence as its one shingle. A
    null or empty text, or one without words, has no shingle and is linked with
    nothing: its class and component are its own doc_id. A row whose doc_id is
    null takes part, but never names a class unless all ids in it are null.
    Repeated rows and rows with the same doc_id give a row each. Other columns
    are ignored, whatever their names.
    """
    scratch = Scratch(spark)
    counts = gram_counts(docs, text_col, k, counters)
    rows = scratch.save(prefix_rows(docs, id_col, text_col, k, num, den, scratch.share(counts)), "rows")
    scratch.release()
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("marks"))
    classes = scratch.save(classes, "classes")

    def sets_of(pairs: DataFrame) -> DataFrame:
        # Another pass over the texts, for the ids of the pairs' classes.
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        wanted = scratch.save(classes.join(ends, "key", "left_semi").select("key", "class_id"), "wanted")
        held = scratch.share(bitmap(wanted, "class_id"))
        return whole_sets(docs, id_col, text_col, k, held).join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("grams").alias("grams"))

    label = link_classes(spark, scratch, classes, sets_of, num, den, ordered=True)
    named = classes.join(label.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "class_id", F.coalesce("component", "key").alias("part"))
    least = named.groupBy("part").agg(F.min("class_id").alias("component_id"))
    named = scratch.save(named.join(least, "part").select("key", "class_id", "component_id", "part"), "named")
    tidy(spark)
    full = rows.filter("n > 0").select("doc_id", "row_key", "n", "key").join(named, "key").select("doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id", "part")
    return full.union(rows.filter("n = 0").select("doc_id", "row_key", F.lit(0).cast("long"), "doc_id", "doc_id", F.lit(None).cast("long")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark, table(spark, sf_dir, "documents"), k=3, num=90, den=100).drop("row_key", "part")


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
_WORDS = "list_filter(regexp_split_to_array(lower_az, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_AZ} AS lower_az FROM documents)
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS g
  FROM w
), n AS (
  SELECT doc_id, CAST(len(g) AS BIGINT) AS n, g FROM s
), e AS (
  SELECT doc_id, n, unnest(g) AS g FROM n
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
), comp AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), same AS (
  SELECT doc_id, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(g), n = 0) END AS class_id FROM n
)
SELECT n.doc_id, n.n AS n_shingles, class_id, component_id
FROM n JOIN comp ON comp.a = n.doc_id JOIN same ON same.doc_id = n.doc_id
"""
}
