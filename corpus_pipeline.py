"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet and reads again as the next stage's docs. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polycell.llm import bpe, mixing, ngram_jaccard, paragraphs, toxicity
from polycell.llm.common import Scratch, bitmap, held_by, table, temporary

#: Jaccard similarity, in per cent, and words of a shingle for near-duplicate documents.
SIMILARITY, SHINGLE = 80, 5
#: A document's score from which it counts as toxic.
TOXIC = 0.3
#: Least rate of the mixing stage: no document is lost.
LEAST = 1.0
#: Pieces that a worker of the last stage remembers; the other stages' workers and heaps are still there.
REMEMBERED = 120_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance takes for toxic go; learned from labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, ~toxicity.in_fold())
    return toxicity.score(docs, model, TOXIC, ("__score", "__toxic")).filter("__toxic = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest (doc_id, hash of the row) stays, once if repeated."""
    scratch = Scratch(spark)
    found = scratch.save(ngram_jaccard.ngram_jaccard_join(spark, docs, SHINGLE, SIMILARITY, 100).filter("n_shingles > 0"), "groups")
    rows = found.groupBy("part", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("times"))
    kept = found.groupBy("part").agg(F.min(F.struct("doc_id", "row_key")).alias("kept"))
    rows = rows.join(kept, "part").select("row_key", "times", (F.col("row_key") == F.col("kept.row_key")).alias("stays"))
    touched = scratch.save(rows.filter("not stays or times > 1"), "touched")
    # Only rows that go, or are there more than once, take part in a shuffle.
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    inside = held_by(key, bitmap(touched, "row_key"), spark)
    rest = docs.filter(~inside)
    gone = touched.filter("not stays").select(F.col("row_key").alias("__k"))
    again = touched.filter("stays").select(F.col("row_key").alias("__k"), F.lit(True).alias("__again")).distinct()
    some = docs.filter(inside).withColumn("__k", key).join(gone, "__k", "left_anti").join(again, "__k", "left")
    once = some.filter("__again").dropDuplicates(["__k"])
    return rest.unionByName(some.filter("__again is null").select(*docs.columns)).unionByName(once.select(*docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs and passages that repeat earlier ones are cut from the texts."""
    return paragraphs.without_repeats(spark, docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by their fitted rates, so that expected tokens per language meet the targets.

    No rate is below 1, so no document is lost; the fraction of a rate above its
    whole part is a further copy for documents whose hash falls below it.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    source = table(spark, sf_dir, "documents")
    labelled = source.join(labels, "doc_id").select("doc_id", F.col("lang").alias("domain"))
    model = mixing.train(*mixing.labelled_sample(source, labelled, sorted(mixing.TARGETS)), sorted(mixing.TARGETS))
    place = Scratch(spark).save(mixing.memberships(docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text"), model), "memberships")
    gradients, report = mixing.fit_rates(place, [mixing.TARGETS[d] for d in sorted(mixing.TARGETS)], least=LEAST)
    if report["error"] > mixing.TOLERANCE:
        warnings.warn(f"mixing: {report['error']:.2%} of the tokens miss their targets after {report['steps']} steps", stacklevel=2)
    return mixing.repeated(docs, model, gradients, LEAST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every whole text as BPE ids, and hashes of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_languages),
    ("bpe", encode),
]

#: SQL can't express the trained and iterative stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark):
            docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
