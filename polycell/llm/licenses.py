"""License scans as an exact set-similarity join, with DataFrame functions only.

Templates are license notices. Blocks are all runs of consecutive words of a text,
over line ends or not, as long as the template and a quarter more (``span``). A
block's set is its distinct words. It meets a template when it contains at least
``threshold`` of the template's distinct words, that is o = ceil(threshold |T|) of
them, and tells it from its rivals: of another template whose own words would
suffice for that, at least one word must be missing there and stand here. All such
pairs are found with the usual filters of exact joins:

* order: words of templates are ordered by their document counts over the whole
  corpus, rare ones first; words outside all templates come after them and can
  be left out of the sets, as they match nothing;
* prefix: a block with o common words has one of the template's |T| - o + 1 rarest;
  so only blocks around such a word are looked at, together as its neighbourhood;
* length: a neighbourhood with fewer than o words can't meet the template;
* position: words before, at and after the shared one must add up to o.

Templates are fixed text of this module or a parameter, so their table is small
whatever the corpus: it joins as a broadcast and the documents aren't shuffled.
Only the few (neighbourhood, template) candidates are, to be verified block by
block and gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Phrases of the base and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices that common licenses ask to be shown, with labels of our own.
TEMPLATES = {
    "notice:gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "notice:gpl-work": "this work is licensed under the gnu general public license version",
    "notice:lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "notice:apache": "licensed under the apache license version",
    "notice:mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "notice:mit-release": "released under the mit license",
    "notice:bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "notice:mpl": "this source code form is subject to the terms of the mozilla public license",
    "notice:cc-by-nc": "licensed under cc by nc",
    "notice:cc-by-sa": "licensed under cc by sa",
    "notice:cc-by": "this work is licensed under a creative commons attribution license",
    "notice:public-domain": "this work is dedicated to the public domain",
    "notice:reserved": "all rights reserved",
}

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """The words, lower-cased in A-Z, with a space before, between and after them; '' without words."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UP, _LOW), _BETWEEN, " "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _places(p: Column, phrase: str) -> Column:
    # Each word gets spaces of its own, so that neighbouring places don't share one.
    doubled, wide = F.replace(p, F.lit(" "), F.lit("  ")), " " + phrase.replace(" ", "  ") + " "
    return ((F.octet_length(doubled) - F.octet_length(F.replace(doubled, F.lit(wide), F.lit("")))) / len(wide)).cast("long")


def _first(p: Column, phrase: str) -> Column:
    return _spaces(F.substring_index(p, f" {phrase} ", 1)).cast("long")


def _last(p: Column, phrase: str) -> Column:
    # Words up to the end, less those from the last place on.
    tail = F.substring_index(p, f" {phrase} ", -1)
    return (_spaces(p) - 1 - _spaces(tail) - len(phrase.split())).cast("long")


def span(template: str) -> int:
    """Words of a block that may meet the template."""
    n = len(template.split())
    return n + max(4, n // 4)


def rivals(label: str, sets: dict[str, list[str]], need: dict[str, int]) -> list[list[str]]:
    """Words of the template that each template lacks whose words would suffice to meet it."""
    own = set(sets[label])
    return [sorted(own - set(s)) for other, s in sets.items() if other != label and own - set(s) and len(own & set(s)) >= need[label]]


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """Labels of every document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Phrases and templates are lower-case words with single spaces. score is 1
    where a phrase stands, else the largest contained share of a template that a
    block of the whole text meets, else 0. Null and empty texts have no words, no labels and score
    0. Repeated rows give a row each; a null doc_id is kept; other columns are
    ignored. A phrase that begins with the word that it ends with is an error.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    if any(len(w) > 1 and w[0] == w[-1] for w in map(str.split, phrases)):
        raise ValueError("a phrase may not begin with the word that it ends with")
    scratch = Scratch(spark)
    sets = {label: sorted(set(text.split())) for label, text in templates.items()}
    need = {label: max(1, math.ceil(threshold * len(s) - 1e-9)) for label, s in sets.items()}
    vocabulary = sorted({w for s in sets.values() for w in s})
    literal = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
    p = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    seen = p.select(F.explode(F.array_intersect(F.split(normal(F.col("text")), " "), literal(vocabulary))).alias("w")).groupBy("w").count()
    often = {r["w"]: r["count"] for r in seen.collect()}  # a row per template word at most
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefix = []
    for label, s in sets.items():
        ranks = sorted(rank[w] for w in s)
        apart = [sorted(rank[w] for w in r) for r in rivals(label, sets, need)]
        prefix += [(r, label, i, ranks, need[label], span(templates[label]), apart) for i, r in enumerate(ranks[: len(ranks) - need[label] + 1])]
    rare = [order[r] for r in sorted({r for r, *_ in prefix})]
    reach = max((x[5] for x in prefix), default=1) - 1

    # One pass over the texts: the base, and the neighbourhoods of rare template words.
    p = p.withColumn("p", normal(F.col("text"))).withColumn("key", F.xxhash64("doc_id", "text"))
    any_phrase = F.lit(False)
    for phrase in phrases:
        any_phrase = any_phrase | F.col("p").contains(f" {phrase} ")
    p = p.withColumn("any", any_phrase)
    total, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in phrases.items():
        here = F.col("p").contains(f" {phrase} ")
        total = total + F.when(here, _places(F.col("p"), phrase)).otherwise(0)
        firsts.append(F.when(here, _first(F.col("p"), phrase)))
        lasts.append(F.when(here, _last(F.col("p"), phrase)))
        labels.append(F.when(here, F.lit(label)))
    words = F.split(F.trim("p"), " ")
    places = F.array_compact(F.transform(words, lambda w, i: F.when(F.array_contains(literal(rare), w), i)))
    first = lambda i: F.greatest(i - reach, F.lit(0))
    ranked = lambda i: F.transform(F.slice(words, first(i) + 1, i - first(i) + 1 + reach), lambda w: F.array_position(literal(order), w).cast("int") - 1)
    blocks = F.transform(places, lambda i: F.struct(i.alias("at"), first(i).alias("first"), ranked(i).alias("ranked")))
    none = F.lit(None).cast("long")
    done = p.select(
        "doc_id",
        "key",
        F.when(F.col("p") == "", 0).otherwise(_spaces(F.col("p")) - 1).cast("long").alias("n_words"),
        F.when(F.col("any"), total).otherwise(0).cast("long").alias("n_base"),
        F.when(F.col("any"), F.array_min(F.array(*firsts))).otherwise(none).alias("first_word"),
        F.when(F.col("any"), F.array_max(F.array(*lasts))).otherwise(none).alias("last_word"),
        F.when(F.col("any"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))).otherwise(literal([])).alias("base"),
        F.when(F.size(F.array_intersect(F.split("p", " "), literal(rare))) > 0, blocks).alias("blocks"),
    )
    done = scratch.save(done, "scan")

    kind = "array<struct<rank: int, label: string, i: int, ranks: array<int>, need: int, span: int, apart: array<array<int>>>>"
    ints = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    posting = lambda r, label, i, ranks, o, n, apart: F.struct(F.lit(r).alias("rank"), F.lit(label).alias("label"), F.lit(i).alias("i"), ints(ranks).alias("ranks"), F.lit(o).alias("need"), F.lit(n).alias("span"), F.array(*map(ints, apart)).cast("array<array<int>>").alias("apart"))
    postings = F.broadcast(spark.range(1).select(F.explode(F.array(*[posting(*x) for x in prefix]).cast(kind)).alias("p")).select("p.*"))
    b = done.filter("blocks is not null").dropDuplicates(["key"]).select("key", F.explode("blocks").alias("b")).select("key", "b.*")
    b = b.withColumn("rank", F.expr("ranked[at - first]")).withColumn("own", F.expr("array_sort(array_distinct(filter(ranked, r -> r >= 0)))"))
    b = b.join(postings, "rank").withColumn("j", F.expr("cast(array_position(own, rank) as int) - 1"))
    candidates = b.filter("size(own) >= need and least(i, j) + 1 + least(size(ranks) - i - 1, size(own) - j - 1) >= need and size(array_intersect(own, ranks)) >= need")
    # Every block of the span that holds the rare word.
    block = "slice(ranked, s - first + 1, span)"
    met = f"filter(transform(sequence(greatest(at - span + 1, 0), at), s -> if(forall(apart, a -> arrays_overlap(a, {block})), size(array_intersect({block}, ranks)), 0)), n -> n >= need)"
    found = candidates.withColumn("both", F.expr(f"array_max({met})")).filter("both is not null")
    found = found.groupBy("key").agg(F.sort_array(F.collect_set("label")).alias("more"), F.max(F.col("both") / F.size("ranks")).alias("share"))

    out = done.join(found, "key", "left")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", literal([])))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))


def _sql() -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    phrases = ", ".join(f"('{p}', '{v}')" for p, v in PHRASES.items())
    sets = {label: sorted(set(text.split())) for label, text in TEMPLATES.items()}
    need = {label: max(1, math.ceil(0.9 * len(t) - 1e-9)) for label, t in sets.items()}
    templates = ", ".join(f"('{k}', '{t}', {span(t)}, {rivals(k, sets, need)!r}::VARCHAR[][])" for k, t in TEMPLATES.items())
    return f"""
WITH ph AS (
  SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) v(p, label)
), te AS (
  SELECT label, list_distinct(string_split(t, ' ')) AS t, span, apart FROM (VALUES {templates}) v(label, t, span, apart)
), d AS (
  SELECT doc_id, text, {words.format("text")} AS w FROM documents
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base
  FROM (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i+1:i+len(p)] = p)) AS i FROM d, ph)
  GROUP BY doc_id
), bl AS (
  SELECT doc_id, label, t, apart, w[s + 1 : s + span] AS b FROM (
    SELECT doc_id, label, t, apart, span, w, unnest(range(0, len(w))) AS s FROM d, te WHERE len(list_intersect(w, t)) >= ceil(0.9 * len(t) - 1e-9))
), more AS (
  SELECT doc_id, list_sort(list_distinct(list(label))) AS more, max(n / len(t)) AS share
  FROM (SELECT doc_id, label, t, len(list_intersect(b, t)) AS n FROM bl WHERE len(list_filter(apart, lambda a: len(list_intersect(a, b)) = 0)) = 0)
  WHERE n >= ceil(0.9 * len(t) - 1e-9) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_concat(coalesce(base, []), coalesce(more, []))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


SQL = {"op6_license_scan": _sql()}
QUERIES = {"op6_license_scan": op6_license_scan}
