"""License notices by diagonal voting: texts and templates meet in word k-grams.

Every rolling k-gram of a text is joined by its hash with the k-grams of the
templates and then compared word by word.  A common k-gram at word i of the text
and word p of the template votes for the diagonal i - p, the place where the
template would begin.  Neighbouring diagonals are merged, so words put in or left
out move only the rest of a notice; a merged diagonal is confirmed by the share of
the template's k-grams that it holds.

Built-in functions only.  A text meets the templates where it is read: what is
shuffled are the votes, a few rows per notice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 3
SLACK = 2
COVERAGE = 0.8

# Templates of more words than this are joined by a shuffle, not broadcast.
BROADCAST_WORDS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A notice: ``exact`` ones count every place where all their words stand in a row."""
    label: str
    text: str
    exact: bool = False


# Phrases that every word must match.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

# Public license notices, of which a share of the k-grams must match.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction including "
             "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
             "copies of the software"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except "
             "in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as "
             "published by the free software foundation either version 3 of the license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by", "creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("all-rights-reserved", "all rights reserved"),
)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; characters beyond ASCII count as letters."""
    text = F.coalesce(text, F.lit(""))
    # where all is ASCII the plain lower() does the same, faster
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def _key(doc_id: Column, text: Column) -> Column:
    """Names a row by what is in it; rows equal in id and text have equal notices."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))


def template_grams(spark: SparkSession, templates: tuple[Template, ...], width: int = WIDTH) -> DataFrame:
    """One row per k-gram of a template: its words, its place, and the number of all."""
    listed = F.array(*[F.struct(F.lit(n).alias("_t"), F.lit(t.label).alias("_label"), F.lit(t.exact).alias("_exact"),
                                F.lit(t.text).alias("_text")) for n, t in enumerate(templates)])
    rows = spark.range(1).select(F.inline(listed)).withColumn("_words", words(F.col("_text")))
    rows = rows.filter(F.size("_words") >= width).withColumn("_grams", F.size("_words") - (width - 1))
    rows = rows.select("_t", "_label", "_exact", "_words", "_grams", F.explode(
        F.sequence(F.lit(0), F.col("_grams") - 1)).alias("_p"))
    return rows.select("_t", "_label", "_exact", "_grams", "_p",
                       F.slice("_words", F.col("_p") + 1, width).alias("_gram"), _hash("_words", "_p", width).alias("_h"))


def _hash(array: str, at: str, width: int) -> Column:
    return F.xxhash64(*[F.get(F.col(array), F.col(at) + i) for i in range(width)])


def votes(docs: DataFrame, templates: tuple[Template, ...], width: int = WIDTH, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """Per text, template and diagonal: the template's k-grams found there."""
    if any(t.exact and len(t.text.split()) < width for t in templates):
        raise ValueError(f"an exact template needs at least {width} words")
    grams = template_grams(docs.sparkSession, templates, width)
    if sum(len(t.text.split()) for t in templates) <= BROADCAST_WORDS:
        grams = F.broadcast(grams)
    # the outer form, as the inner one would split every text a second time to look for empty ones
    rolling = (docs.select(_key(F.col(doc_id), F.col(text)).alias("_key"), words(F.col(text)).alias("_doc"))
               .select("_key", "_doc", F.posexplode_outer("_doc").alias("_i", "_"))
               .filter(F.col("_i") <= F.size("_doc") - width)
               .withColumn("_h", _hash("_doc", "_i", width)))
    # an equality would become a part of the join's key, and all rows would build it
    here = F.slice("_doc", F.col("_i") + 1, width)
    met = rolling.join(grams, "_h").filter((here <= F.col("_gram")) & (here >= F.col("_gram")))
    return (met.groupBy("_key", "_t", "_label", "_exact", "_grams", (F.col("_i") - F.col("_p")).alias("_diagonal"))
            .agg(F.collect_set("_p").alias("_found")))


def spans(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, width: int = WIDTH, slack: int = SLACK,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every merged diagonal: _key, label, exact, start (word), coverage (0 to 1).

    An exact template's diagonal stands alone; others take the diagonals up to
    ``slack`` words further on into account.  No more than those are merged, so a
    text that repeats a notice has a span for each time.
    """
    near = W.partitionBy("_key", "_t").orderBy("_diagonal").rangeBetween(0, slack)
    merged = F.when(F.col("_exact"), F.col("_found")).otherwise(
        F.array_distinct(F.flatten(F.collect_list("_found").over(near))))
    return votes(docs, templates, width, doc_id, text).select(
        "_key", F.col("_label").alias("label"), F.col("_exact").alias("exact"),
        F.col("_diagonal").cast("long").alias("start"), (F.size(merged) / F.col("_grams")).alias("coverage"))


def report(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, width: int = WIDTH, slack: int = SLACK,
           coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_words, places of the exact phrases, labels, and the best coverage.

    A null text is empty and has neither words nor labels (empty strings, score 0).
    Rows equal in id and text, also with a null id, each have their row.  Extra
    columns are not looked at.  An empty table has no rows.
    """
    found = spans(docs, templates, width, slack, doc_id, text)
    place = F.col("exact") & (F.col("coverage") == 1.0)
    told = F.when(F.col("exact"), F.col("coverage") == 1.0).otherwise(F.col("coverage") >= coverage)
    per_text = found.groupBy("_key").agg(
        F.count(F.when(place, 1)).alias("_n"), F.min(F.when(place, F.col("start"))).alias("first_word"),
        F.max(F.when(place, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("_base"),
        F.array_join(F.array_sort(F.collect_set(F.when(told, F.col("label")))), ",").alias("_labels"),
        F.max("coverage").alias("_score"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(F.col(doc_id), F.col(text)).alias("_key"),
                       F.size(words(F.col(text))).cast("long").alias("n_words"))
    return rows.join(per_text, "_key", "left").select(
        "doc_id", "n_words", F.coalesce("_n", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("_base", F.lit("")).alias("base_labels"), F.coalesce("_labels", F.lit("")).alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"))
