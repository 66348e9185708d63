"""License scans with a positional rare-token index, in DataFrame functions alone.

A template is a line of words with the label it stands for; its mandatory key phrases are the places whose words must
stand in the file. The rarest of those words in the corpus (highest IDF, from a count over all documents) are the
template's postings: word to (template, place). Each file's words are looked up there; a word at position p that
is posted at place q puts the template's start at p - q, and a start counts where all of the template's posted words
agree on it. The mandatory places are then verified, and the other words give the share that stands in place.

Nothing is shuffled but the word counts, which combine in the map tasks; the postings are bounded by the templates.

Defined cases: null and empty texts have no words, no labels and score 0; a template that starts before the file or ends
after it can still match on its mandatory places; a null doc_id stays null; repeated rows give repeated results; an
empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Posted words of a template, and the share of its words that must stand in place.
POSTED, LEAST_SHARE = 2, 0.5


@dataclass(frozen=True)
class Template:
    """``text`` has its mandatory phrases in square brackets; ``base`` templates are phrases, mandatory as a whole."""

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.replace("[", "").replace("]", "").split()

    @property
    def must(self) -> list[int]:
        places, inside = [], self.base
        for i, word in enumerate(self.text.split()):
            inside = inside or word.startswith("[")
            if inside:
                places.append(i)
            inside = self.base or (inside and not word.endswith("]"))
        return places


#: Phrases that are searched in any case, then licence lines (fixed values).
TEMPLATES = [
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("mit", "released under the [mit license]"),
    Template("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this [software and associated documentation files]"),
    Template("apache-2.0", "licensed under the [apache license version 2 0]"),
    Template("cc-by-nc", "licensed under [cc by nc]"),
    Template("cc-by-sa", "licensed under [cc by sa]"),
    Template("cc-by-nd", "licensed under [cc by nd]"),
    Template("cc0", "released under [cc0 1 0]"),
    Template("gpl-2.0", "under the terms of the gnu [general public license version 2]"),
    Template("gpl-3.0", "licensed under the gnu [general public license version 3]"),
    Template("lgpl", "under the terms of the gnu [lesser general public license]"),
    Template("agpl", "under the terms of the gnu [affero general public license]"),
    Template("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license]"),
    Template("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is [free and unencumbered software] released into the public domain"),
]


def words(text_col: str = "text") -> Column:
    """A-Z to lower case, then runs of digits, letters and everything beyond ASCII."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, text_col: str = "text", templates: list[Template] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Documents, and those that hold each mandatory word: as many numbers as the templates have words."""
    vocabulary = sorted({t.words[i] for t in templates for i in t.must})
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words(text_col), F.lit(vocabulary)))).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), counts


def postings(n: int, df: dict[str, int], templates: list[Template] = TEMPLATES, posted: int = POSTED) -> dict[str, list[tuple[int, int]]]:
    """word to (template, place), of each template's mandatory words with the highest IDF (one for a base phrase)."""
    index: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        idf = {i: math.log((n + 1) / (df.get(t.words[i], 0) + 1)) for i in t.must}
        for place in sorted(t.must, key=lambda i: (-idf[i], i))[:1 if t.base else posted]:
            index.setdefault(t.words[place], []).append((number, place))
    return index


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES,
                  least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Numbers and places are of the base phrases; ``labels`` adds those of templates with all mandatory phrases and at
    least ``least_share`` of their words in place; ``score`` is the largest such share of any template, 0 without one.
    """
    index = postings(*document_frequencies(docs, text_col, templates), templates)
    posted = [sum(n == number for rows in index.values() for n, _ in rows) for number in range(len(templates))]

    def rows(pairs):
        return F.array(*[F.struct(F.lit(n).alias("t"), F.lit(q).alias("q")) for n, q in pairs])
    by_word = F.create_map(*[x for w, pairs in sorted(index.items()) for x in (F.lit(w), rows(pairs))])
    table = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.words).alias("words"), F.lit(t.must).alias("must"), F.lit(n).alias("posted"))
                      for t, n in zip(templates, posted, strict=True)])

    files = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), words(text_col).alias("w"))
    # positions of posted words, as (template, start), one for each posting
    hits = files.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: F.get("w", i).isin(sorted(index))))
    starts = hits.withColumn("starts", F.flatten(F.transform("at", lambda i: F.transform(
        F.element_at(by_word, F.get("w", i)), lambda p: F.struct(p["t"].alias("t"), (i - p["q"]).alias("start"))))))
    # all posted words agree on the start: each start has as many entries as the template has postings
    sorted_starts = starts.withColumn("starts", F.array_sort("starts"))
    agreed = sorted_starts.withColumn("starts", F.filter("starts", lambda s, k: (
        F.get("starts", k + F.get(table, s["t"])["posted"] - 1).eqNullSafe(s))
        & ~F.coalesce(F.get("starts", k - 1), F.struct(F.lit(-1).alias("t"), F.lit(0).alias("start"))).eqNullSafe(s)))

    def placed(s):
        t = F.get(table, s["t"])
        right = F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1), lambda j: F.get("w", s["start"] + j) == F.get(t["words"], j))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), s["start"].alias("start"),
                        F.size(F.array_except(t["must"], right)).alias("missing"), (F.size(right).cast("double") / F.size(t["words"])).alias("share"))
    found = agreed.withColumn("found", F.filter(F.transform("starts", placed), lambda x: (x["missing"] == 0) & (x["share"] >= least_share)))
    base = found.withColumn("base", F.filter("found", lambda x: x["base"]))

    def labels(column):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda x: x["label"]))), ",")
    place = F.transform("base", lambda x: x["start"].cast("bigint"))
    return base.select(
        "doc_id", F.size("w").cast("bigint").alias("n_words"), F.size("base").cast("bigint").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        labels("base").alias("base_labels"), labels("found").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"))
