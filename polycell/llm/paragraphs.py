"""Substring dedup: paragraphs by MinHash banding, passages by content-defined paragraphs.

Paragraphs are of two kinds, both from whole texts:

* lines of at least ``SHINGLE`` words. Lines with equal sets of 5-word shingles are
  one class, MinHash bands over the sets bring classes together, exact Jaccard similarity on whole sets decides, and
  clusters are the components of the links. Of a cluster, the first line stays.
* content-defined paragraphs, for passages that stand within other text. They
  begin where a 5-word shingle's hash is the least of its neighbourhood, so that
  a passage is cut in the same places wherever it stands. Equal ones are a
  cluster; of a cluster the first stays. Others are removed where they make up a
  run of at least ``MIN_WORDS`` words.

Bands: at similarity 0.8 a pair of lines meets in one of 5 bands of 3 values with
probability 1 - (1 - 0.8**3)**5 = 0.97, at 0.9 with 0.998.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bitmap, held_by, in_bitmap, table, tidy
from .ngram_jaccard import BITS, _key, bitmap_of, link_classes
from .textkernel import chunks, mix, word_hashes, word_spans

#: Words of a shingle, and of the shortest line; words of the shortest run of repeated passages inside lines.
SHINGLE, MIN_WORDS = 5, 20
BANDS, BAND_ROWS = 5, 3
#: Half the neighbourhood, in words, in which a content-defined paragraph's first shingle is the least.
REACH = 5
_SEEDS = np.random.default_rng(20).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


class Chunk:
    """Words, shingles and lines of some rows' texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.words, self.first = word_hashes(data, offsets)
        self.starts, self.ends, _ = word_spans(data, offsets)
        with np.errstate(over="ignore"):
            s = self.words.copy()
            for t in range(1, SHINGLE):
                s[:-t] = s[:-t] * _P + self.words[t:]
            self.shingles = mix(s)

    def lines(self):
        """(row, first word, end word) of lines with SHINGLE words at least."""
        if not len(self.words):
            return np.zeros((0, 3), np.int64)
        row = np.searchsorted(self.first, np.arange(len(self.words)), side="right") - 1
        line = np.searchsorted(np.flatnonzero(self.data == 10), self.starts)
        cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(line) != 0)) + 1
        a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(self.words)]])
        keep = b - a >= SHINGLE
        return np.stack([row[a[keep]], a[keep], b[keep]], axis=1)

    def bands(self, lines: np.ndarray) -> np.ndarray:
        """Band values of each line, (lines, BANDS)."""
        if not len(lines):
            return np.zeros((0, BANDS), np.int64)
        bounds = np.stack([lines[:, 1], lines[:, 2] - SHINGLE + 1], axis=1).reshape(-1)
        out = np.zeros((len(lines), BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for j, seed in enumerate(_SEEDS):
                values = np.append(mix(self.shingles ^ seed), _MAX)
                least = np.minimum.reduceat(values, bounds)[::2]
                out[:, j // BAND_ROWS] = out[:, j // BAND_ROWS] * _P + least
            out = mix(out + np.arange(1, BANDS + 1, dtype=np.uint64))
        return out.view(np.int64)

    def sets(self, lines: np.ndarray):
        return [np.unique(self.shingles[a : b - SHINGLE + 1]) for _, a, b in lines]

    def pieces(self):
        """(row, first word, end word, value) of content-defined paragraphs, with the shingle that ends them."""
        n = len(self.words)
        row = np.searchsorted(self.first, np.arange(n), side="right") - 1
        whole = np.arange(n) + SHINGLE <= self.first[row + 1] if n else np.zeros(0, bool)
        gap = REACH
        at = np.arange(n) + gap * (row + 1)
        s = np.full(n + gap * (len(self.offsets) + 1), _MAX)
        s[at[whole]] = self.shingles[whole]
        left, right = np.full_like(s, _MAX), np.full_like(s, _MAX)
        for d in range(1, REACH + 1):
            left[d:] = np.minimum(left[d:], s[:-d])
            right[:-d] = np.minimum(right[:-d], s[d:])
        anchors = np.flatnonzero(whole & (s[at] < left[at]) & (s[at] <= right[at])) if n else np.zeros(0, np.int64)
        same = row[anchors[1:]] == row[anchors[:-1]]
        a, b = anchors[:-1][same], anchors[1:][same] + SHINGLE
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P)]))
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P_INVERSE)]))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.words * power[:n], dtype=np.uint64)])
            value = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
        return row[a], a, b, value.view(np.int64)


_SCHEMA = "doc_id long, row_key long, line boolean, start int, end int, w0 int, w1 int, key long, n int, bits array<long>, marks array<long>"


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """A row per paragraph of docs (doc_id, text): place in bytes and words, value; sets and bands of lines."""

    def rows(batches):
        for b in batches:
            ids, row_keys, column = b.columns
            for r, data, offsets in chunks(column):
                c = Chunk(data, offsets)
                lines = c.lines()
                sets, m = c.sets(lines), len(lines)
                bits = np.array([bitmap_of(s) for s in sets], np.uint8).reshape(-1).view(np.int64)
                row, a, z, value = c.pieces()
                total = m + len(row)
                row, a, z = np.concatenate([lines[:, 0], row]), np.concatenate([lines[:, 1], a]), np.concatenate([lines[:, 2], z])
                names = np.concatenate([np.array([_key(s) for s in sets], np.int64), value])
                sizes = np.concatenate([np.array([len(s) for s in sets], np.int32), np.zeros(len(value), np.int32)])
                ends = np.minimum(np.arange(total + 1), m)
                base = offsets[row]
                place = pa.array(row + r)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(place),
                        row_keys.take(place),
                        pa.array(np.arange(total) < m),
                        pa.array((c.starts[a] - base).astype(np.int32)),
                        pa.array((c.ends[z - 1] - base).astype(np.int32)),
                        pa.array((a - c.first[row]).astype(np.int32)),
                        pa.array((z - c.first[row]).astype(np.int32)),
                        pa.array(names),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(ends * (BITS // 64), pa.int32()), pa.array(bits)),
                        pa.ListArray.from_arrays(pa.array(ends * BANDS, pa.int32()), pa.array(c.bands(lines).reshape(-1))),
                    ],
                    [x.split()[0] for x in _SCHEMA.split(", ")],
                )

    return docs.select("doc_id", "row_key", "text").mapInArrow(rows, _SCHEMA)


def _line_sets(docs: DataFrame, wanted) -> DataFrame:
    """(key, grams) of all lines of rows in the filter."""

    def rows(batches):
        for b in batches:
            keep = np.flatnonzero(in_bitmap(b.column(0).to_numpy(zero_copy_only=False), wanted.value))
            if not len(keep):
                continue
            for _, data, offsets in chunks(b.column(1).take(pa.array(keep))):
                c = Chunk(data, offsets)
                sets = c.sets(c.lines())
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["key", "grams"])

    return docs.select(F.xxhash64("row_key"), "text").mapInArrow(rows, "key long, grams binary")


def merge_spans(found, least=MIN_WORDS):
    """(start, end, words) to remove, in order and apart, from (line, start, end, w0, w1) of repeated paragraphs."""
    spans = [(r["w0"], r["w1"], r["start"], r["end"]) for r in found if r["line"]]
    run = None
    for r in sorted((r for r in found if not r["line"]), key=lambda r: r["w0"]):
        if run and r["w0"] <= run[1]:
            run = (run[0], max(run[1], r["w1"]), run[2], max(run[3], r["end"]))
        else:
            if run and run[1] - run[0] >= least:
                spans.append(run)
            run = (r["w0"], r["w1"], r["start"], r["end"])
    if run and run[1] - run[0] >= least:
        spans.append(run)
    out: list[list[int]] = []
    for w0, w1, a, z in sorted(spans):
        if out and w0 <= out[-1][1]:
            if w1 > out[-1][1]:
                out[-1][1], out[-1][3] = w1, z
        else:
            out.append([w0, w1, a, z])
    return [(a, z, w1 - w0) for w0, w1, a, z in out]


def repeated_spans(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, row_key, spans) of documents with repeated paragraphs; spans: (start, end, words) in bytes of the text.

    Which of a cluster's paragraphs is first goes by doc_id (null first), then by
    row_key (xxhash64 of id and text) and place; so repeated rows, which are equal
    in all of these, keep and lose the same paragraphs. Null and empty texts have
    none. Other columns are ignored.
    """
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    rows = scratch.save(paragraph_rows(docs), "paragraphs")
    place = F.struct("doc_id", "row_key", "start")

    lines = rows.filter("line")
    classes = lines.groupBy("key").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("marks").alias("marks"))
    classes = scratch.save(classes, "line_classes")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        wanted = scratch.save(classes.join(ends, "key", "left_semi").select("key", "head.row_key"), "wanted")
        held = scratch.share(bitmap(wanted, "row_key"))
        return _line_sets(docs, held).join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("grams").alias("grams"))

    label = link_classes(spark, scratch, classes, sets_of, num, den, ordered=False)
    named = classes.select("key", "head", "copies").join(label.select(F.col("node").alias("key"), "component"), "key", "left").filter("copies > 1 or component is not null")
    named = named.select("key", "head", F.coalesce("component", "key").alias("component"))
    heads = named.groupBy("component").agg(F.min("head").alias("kept"))
    named = named.join(heads, "component").select("key", "kept")
    again = lines.select("doc_id", "row_key", "line", "start", "end", "w0", "w1", "key").join(named, "key").filter(~place.eqNullSafe(F.col("kept")))

    pieces = rows.filter("not line").select("doc_id", "row_key", "line", "start", "end", "w0", "w1", "key")
    common = pieces.groupBy("key").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("key", "kept")
    runs = pieces.join(common, "key").filter(~place.eqNullSafe(F.col("kept")))

    found = again.drop("kept").unionByName(runs.drop("kept")).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("line", "start", "end", "w0", "w1")).alias("found"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))

    @F.arrow_udf("array<struct<start: int, end: int, words: int>>")
    def merge(rows: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": z, "words": n} for a, z, n in merge_spans(r)] for r in rows.to_pylist()], kind)

    out = scratch.save(found.select("doc_id", "row_key", merge("found").alias("spans")).filter("size(spans) > 0"), "spans")
    scratch.drop(rows, classes)
    tidy(spark)
    return out


def cut(text: bytes, spans) -> bytes:
    """The text without the spans; a line that has nothing left goes with its line end."""
    out, at = [], 0
    for a, z, *_ in spans:
        while z < len(text) and text[z] in b" \t":
            z += 1
        if z < len(text) and text[z] == 10 and (a == 0 or text[a - 1] == 10):
            z += 1
        out.append(text[at:a])
        at = z
    out.append(text[at:])
    return b"".join(out)


def without_repeats(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with repeated paragraphs cut from the texts; documents with nothing but white space left are removed.

    n_chars is set anew if there is such a column. Documents without repeats pass
    as they are, also those that were empty before; only the others are shuffled.
    """
    spans = repeated_spans(spark, docs, num, den)
    names = docs.columns
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    touched = bitmap(spans, "row_key")
    inside = held_by(key, touched, spark)
    rest = docs.filter(~inside)
    some = docs.filter(inside).withColumn("__row_key", key).join(spans.select(F.col("row_key").alias("__row_key"), F.col("spans").alias("__spans")).dropDuplicates(["__row_key"]), "__row_key", "left")

    @F.arrow_udf("string")
    def clean(text: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([t if s is None else cut(t.encode(), [(x["start"], x["end"]) for x in s]).decode() for t, s in zip(text.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    some = some.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean("text", "__spans")))
    some = some.filter("__spans is null or text rlike '[^ \\t-\\r]'")
    if "n_chars" in names:
        some = some.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rest.unionByName(some.select(*names))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: what of its text repeats earlier paragraphs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = repeated_spans(spark, docs)
    all_ = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    total = lambda field: F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + field(x)), F.lit(0)).cast("long")
    return all_.join(spans.drop("doc_id"), "row_key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_removed"),
        total(lambda x: x["words"].cast("long")).alias("removed_words"),
        total(lambda x: (x["end"] - x["start"]).cast("long")).alias("removed_bytes"),
        F.coalesce(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), F.array().cast("array<string>")).alias("removed"),
    )


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
SQL: dict[str, str] = {}
