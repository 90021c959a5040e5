"""Licence scan by a positional rare-token index (DataFrame functions only).

The index holds, for each word of a template, the templates and positions at
which it stands (its postings). A first pass counts in how many documents each
template word occurs. Of each template, its words in the document with the
highest IDF are looked up, ``RARE`` or more; each place of such a word, less the position of its posting,
gives a template and a start. Places that agree on both intersect there, and a
start is verified against the document's words: every key word of the
template must stand in its place and ``ACCEPT`` of all words must match.

No start that would be accepted is missed, however many licences a document
carries: such a start lacks at most 1 - ACCEPT of the template's words, and the
words looked up are at least ``VOTES`` more than that. Where fewer are present,
all are looked up, and the key words alone give the votes.

Fixed phrases (BASE) are found exactly, wherever they stand.

Defined cases: a null text counts as empty (no words, no labels, score 0);
repeated rows are scanned each; an empty table gives an empty result; ties in
IDF are broken by the word; other columns are never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, ACCEPT, VOTES = 6, 0.75, 2

# Phrases of the contract and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening words of well-known public licences; key words stand in capitals.
TEMPLATES = [
    ("mit", "permission is hereby GRANTED FREE OF CHARGE to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the MIT LICENSE"),
    ("apache-2", "licensed under the APACHE LICENSE VERSION 2 0"),
    ("apache-2", "you may not use this file EXCEPT IN COMPLIANCE WITH THE LICENSE you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under CC BY NC 4 0"),
    ("cc-by-nc", "CREATIVE COMMONS ATTRIBUTION NONCOMMERCIAL 4 0 international license"),
    ("cc-by-sa", "CREATIVE COMMONS ATTRIBUTION SHAREALIKE 4 0 international license"),
    ("cc-by", "CREATIVE COMMONS ATTRIBUTION 4 0 international license"),
    ("gpl-3", "licensed under the GNU GENERAL PUBLIC LICENSE VERSION 3"),
    ("gpl", "redistribute it and or modify it under the terms of the GNU GENERAL PUBLIC LICENSE as published by the free software foundation"),
    ("lgpl", "redistribute it and or modify it under the terms of the GNU LESSER GENERAL PUBLIC LICENSE as published by the free software foundation"),
    ("agpl", "redistribute it and or modify it under the terms of the GNU AFFERO GENERAL PUBLIC LICENSE as published by the free software foundation"),
    ("bsd", "REDISTRIBUTION AND USE IN SOURCE AND BINARY FORMS with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the MOZILLA PUBLIC LICENSE V 2 0"),
    ("isc", "permission to USE COPY MODIFY AND OR DISTRIBUTE this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and UNENCUMBERED SOFTWARE RELEASED INTO THE PUBLIC DOMAIN"),
]
# Words too common in any text to be a licence word.
STOP = "a an and any are as at by for in into is it may not of on or that the this to under use with without you 0 2 3 4 v".split()


class Index:
    """Template words, postings and key positions as literals; their size is that of TEMPLATES."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [label for label, _ in templates]
        self.words = [text.lower().split() for _, text in templates]
        self.keys = [[i for i, w in enumerate(text.split()) if w == w.upper()] for _, text in templates]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for i, w in enumerate(words):
                if w not in STOP:
                    self.postings.setdefault(w, []).append((t, i))

    def postings_map(self) -> Column:
        pairs = []
        for w, at in sorted(self.postings.items()):
            pairs += [F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in at])]
        return F.create_map(*pairs)

    def rarest(self, ranked: list[str]) -> list[tuple[list[str], int]]:
        """Of each template, its index words in the order of ranked, and how many of those in a document to look up."""
        lacking = [len(words) - math.ceil(ACCEPT * len(words)) for words in self.words]
        return [([w for w in ranked if w in words], max(RARE, n + VOTES)) for words, n in zip(self.words, lacking)]

    def words_array(self) -> Column:
        return F.array(*[common.strings(w) for w in self.words])

    def keys_array(self) -> Column:
        return F.array(*[F.array(*[F.lit(i) for i in k]) for k in self.keys])


def with_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """_in (a row of df) and _words: the words of the lower-cased text."""
    text = common.lower_ascii(common.whole_text(df, text_col))
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_in"), F.array_remove(F.split(text, NOT_WORD), "").alias("_words"))


def by_idf(worded: DataFrame, index: Index) -> list[str]:
    """The index words in falling IDF over all documents; as many counts reach the driver as the index has words."""
    words = common.strings(sorted(index.postings))
    counts = (
        worded.select(F.explode(F.array_intersect("_words", words)).alias("w")).groupBy("w").count().collect()
    )
    df = {r["w"]: r["count"] for r in counts}
    return sorted(index.postings, key=lambda w: (df.get(w, 0), w))


def _starts(words: Column, phrase: list[str]) -> Column:
    return F.filter(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: F.forall(
            F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(phrase)]),
            lambda p: F.coalesce(F.get(words, i + p["k"]) == p["w"], F.lit(False)),
        ),
    )


def scan(df: DataFrame, text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """df and n_words, n_base, first_word, last_word, base_labels, labels, score (replaced if df has them)."""
    index = Index(templates)
    worded = with_words(df, text_col)
    ranked = by_idf(worded.select("_words"), index)
    words = F.col("_words")
    none = F.array().cast("array<int>")

    # Places of the fixed phrases, looked for only where all words of one occur.
    found = F.array_intersect(words, common.strings(sorted({w for p in BASE for w in p.split()})))
    out = worded.withColumns({"_found": found, "_present": F.array_intersect(common.strings(ranked), words)})
    rare = F.array_distinct(
        F.flatten(F.array(*[F.slice(F.array_intersect(common.strings(of), F.col("_present")), 1, n) for of, n in index.rarest(ranked)]))
    )
    # Few words in all: the templates' parts of them are all of them.
    out = out.withColumn("_rare", F.when(F.size("_present") <= RARE, F.col("_present")).otherwise(rare))
    places = {}
    for k, phrase in enumerate(BASE):
        p = phrase.split()
        every = F.size(F.array_intersect("_found", common.strings(sorted(set(p))))) == len(set(p))
        places[f"_base{k}"] = F.when(every, _starts(words, p)).otherwise(none)
    # Candidates: template and start, from the places of each template's rarest words.
    occ = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: F.array_contains(F.col("_rare"), x["w"]),
    )
    votes = F.flatten(
        F.transform(
            occ,
            lambda o: F.transform(
                F.element_at(index.postings_map(), o["w"]),
                lambda p: F.struct(p["t"].alias("t"), (o["i"] - p["i"]).alias("at")),
            ),
        )
    )
    # One rare word alone is no intersection; sorted votes show which agree.
    agreed = common.let(
        F.array_sort(votes), lambda v: F.array_distinct(F.filter(v, lambda x, k: x == F.get(v, k + (VOTES - 1))))
    )
    empty = F.array().cast("array<struct<t:int,at:int>>")
    places["_cands"] = F.when(F.size("_rare") >= VOTES, agreed).otherwise(empty)
    out = out.withColumns(places)

    def share(c):
        """Share of the template's words that stand in their places; below 0 if a key word doesn't."""
        t = F.get(index.words_array(), c["t"])
        hits = F.transform(t, lambda w, i: F.coalesce(F.get(words, c["at"] + i) == w, F.lit(False)))

        def judged(h):
            keys = F.forall(F.get(index.keys_array(), c["t"]), lambda i: F.get(h, i))
            return F.struct(keys.alias("keys"), (F.size(F.filter(h, lambda x: x)) / F.size(h)).alias("share"))

        return common.let(hits, judged)

    judged = F.transform(
        "_cands",
        lambda c: common.let(
            share(c),
            lambda j: F.struct(
                (j["keys"] & (j["share"] >= ACCEPT)).alias("ok"),
                j["share"].alias("share"),
                F.get(common.strings(index.labels), c["t"]).alias("label"),
            ),
        ),
    )
    out = out.withColumn("_judged", judged)
    starts = F.concat(*[F.col(f"_base{k}") for k in range(len(BASE))])
    base = F.filter(
        F.array(*[F.when(F.size(f"_base{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values())]),
        lambda x: x.isNotNull(),
    )
    out = out.withColumns({"_starts": starts, "_labels": F.array_sort(F.array_distinct(base))})
    more = F.transform(F.filter("_judged", lambda j: j["ok"]), lambda j: j["label"])
    kept = [F.col("_in")[c].alias(c) for c in df.columns if c not in RESULT]
    return out.select(
        *kept,
        F.size(words).cast("long").alias("n_words"),
        F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"),
        F.array_max("_starts").cast("long").alias("last_word"),
        F.array_join("_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_labels", more)), ",").alias("labels"),
        F.when(F.size("_starts") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform("_judged", lambda j: j["share"])), F.lit(0.0)))
        .alias("score"),
    )


RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *RESULT)
